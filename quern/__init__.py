"""quern: corpus analytics and retrieval evaluation as DataFrame operators."""
