"""The states of an explanation that users ask for: not generated, generating, generated, failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.order import states

NOT_GENERATED, GENERATING, GENERATED, FAILED = range(4)

#: The state after each action in each state. A request starts and completes at once; a start is refused while one is in
#: progress and changes nothing once an explanation is there; completions and failures count in any state.
MOVES = {
    "start": [GENERATING, GENERATING, GENERATED, GENERATING],
    "request": [GENERATED, GENERATING, GENERATED, GENERATED],
    "complete": [GENERATED] * 4,
    "fail": [FAILED] * 4,
}


def outcome(action: Column, state: Column) -> Column:
    """What an action does in the state before it: completed, failed, started, generated, idempotent, in_progress or none."""
    asked = F.when(state == GENERATING, "in_progress").when(state == GENERATED, "idempotent")
    return F.when(action == "complete", "completed").when(action == "fail", "failed").when(action == "start", F.coalesce(asked, F.lit("started"))).when(action == "request", F.coalesce(asked, F.lit("generated"))).otherwise("none")


def generation(events: DataFrame, by: str, order: str) -> DataFrame:
    """Adds state (before the event) and transition to events (by, order, action); any other action, or none, does nothing."""
    return states(events, [by], [order], F.col("action"), MOVES).withColumn("transition", outcome(F.col("action"), F.col("state")))
