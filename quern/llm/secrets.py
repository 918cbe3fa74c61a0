"""Secret scan in DataFrame functions only: fixed patterns, and a battery of randomness tests for other strings.

A long string of an encoding's letters is a secret if it looks drawn at random. Two questions are asked of it.

* Does it look random? The battery tests that: chi-squared uniformity over the encoding's alphabet and over its classes, the
  runs of its lower and upper half, and the correlation of neighbours. A string whose least p-value, times the number of
  tests, is below NOT_RANDOM is dismissed.
* Could it be natural text: a word, an identifier, a path, a number? Under a fixed model of such text (which class of
  character follows which, and how frequent letters and digits are) the likelihood ratio of random to natural has expectation
  1, so its inverse bounds the p-value of "natural". Within each encoding and length band the Benjamini-Hochberg rule reports
  strings with such p-values at a false-discovery rate of FALSE_RATE: of what is reported as `random`, no larger share is
  natural text. Bands keep the many long strings from lending short ones, on which the tests say little, their evidence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import prepare, work_table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of the pattern's maximal runs, those of 20 characters or more
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "random")
FALSE_RATE, NOT_RANDOM = 0.05, 1e-3

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name, what a string must match, its alphabet
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])([0-9a-f]+|[0-9A-F]+)$", _DIGIT + "abcdef"),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _DIGIT + _LOWER),
    ("base36 in capitals", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _DIGIT + _UPPER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGIT),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGIT + "-_"),
)
#: Natural text: letters and digits from frequent to rare with the share of the first and the ratio of each to the one before,
#: and how often a class of character follows another (rows: from lower, upper, digit, other; columns: to the same).
NATURAL_LETTERS, LETTER_RATIO = "etaoinsrhldcumfpgwybvkxjqz", 0.88
NATURAL_DIGITS, DIGIT_RATIO = "0123456789", 0.85
NATURAL_STEPS = ((0.86, 0.06, 0.03, 0.05), (0.70, 0.20, 0.04, 0.06), (0.12, 0.08, 0.68, 0.12), (0.55, 0.20, 0.20, 0.05))
SPAN = "array<struct<s:int,o:int,e:int,k:string>>"
CHUNK = 256


def _located(matches: Column, gaps: Column) -> Column:
    """Structs (s, e, i) of matches, from the texts between them; chunks keep the appending linear in their number."""
    n = F.size(matches)
    rows = F.zip_with(F.slice(gaps, 1, n), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(rows, c * CHUNK + 1, CHUNK))
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    outer = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<s:int,e:int>>>)").alias("out"))

    def step(acc, chunk):
        return F.aggregate(
            chunk,
            F.struct(acc["at"].alias("at"), none.alias("out")),
            lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["m"]).alias("e"))).alias("out")),
            lambda a: F.struct(a["at"].alias("at"), F.array_append(acc["out"], a["out"]).alias("out")),
        )

    return F.when(n > 0, F.aggregate(chunks, outer, step, lambda a: F.flatten(a["out"]))).otherwise(none)


def _named(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("o"), x["e"].alias("e"), F.lit(KINDS[kind]).alias("k")))


def of_kind(found: Column, kind: int) -> Column:
    return F.filter(found, lambda x: x["o"] == kind)


def _tail(z: Column) -> Column:
    """P(|N(0,1)| >= z) for z >= 0."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def _upper_tail(z: Column) -> Column:
    return F.when(z > 0, _tail(z) / 2).otherwise(1 - _tail(-z) / 2)


def _of_encoding(of) -> Column:
    out = F
    for k, (_, _, alphabet) in enumerate(ENCODINGS):
        out = out.when(F.col("enc") == k, of(alphabet))
    return out


def _shares(letters: str, ratio: float) -> dict[str, float]:
    weights = [ratio**k for k in range(len(letters))]
    return {c: w / sum(weights) for c, w in zip(letters, weights, strict=True)}


def _natural_logs() -> tuple[dict[str, float], dict[str, float]]:
    """Natural log-likelihoods: of each character in its class, and of each step between classes ("aA": lower to upper)."""
    letters, digits = _shares(NATURAL_LETTERS, LETTER_RATIO), _shares(NATURAL_DIGITS, DIGIT_RATIO)
    own = {c: math.log(p) for c, p in letters.items()} | {c.upper(): math.log(p) for c, p in letters.items()} | {c: math.log(p) for c, p in digits.items()}
    own |= {c: math.log(1 / 4) for c in "+/_-"}
    return own, {a + b: math.log(NATURAL_STEPS[i][j]) for i, a in enumerate("aA0-") for j, b in enumerate("aA0-")}


def natural_p(text: Column, alphabet_size: Column) -> Column:
    """A bound on the p-value of "natural": natural likelihood over that of a uniform draw from the encoding's alphabet."""
    own, step = _natural_logs()
    kinds = F.translate(text, _UPPER + _LOWER + _DIGIT + "+/_", "A" * 26 + "a" * 26 + "0" * 10 + "---")
    logs = F.lit(math.log(1 / 4))  # the first character's class
    for c, log in own.items():
        logs = logs + (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) * log
    for pair, log in step.items():
        logs = logs + F.regexp_count(kinds, F.lit(f"{pair[0]}(?={pair[1]})")) * log
    return F.least(F.lit(1.0), F.exp(logs + F.length(text) * F.log(alphabet_size)))


def battery(strings: DataFrame) -> DataFrame:
    """Adds p of "random" (null where no encoding fits), p of "natural" (natural), enc and band to rows with a column `v`."""
    enc = F
    for k, (_, pattern, _) in enumerate(ENCODINGS):
        enc = enc.when(F.col("v").rlike(pattern), F.lit(k))
    d = strings.withColumn("enc", enc).withColumn("own", F.when(F.col("enc") == 0, F.lower("v")).otherwise(F.col("v")))
    d = d.withColumn("n", F.length("own").cast("double")).withColumn("m", _of_encoding(lambda a: F.lit(float(len(a)))))
    d = d.withColumn("chars", F.split("own", "")).withColumn("vals", _of_encoding(lambda a: F.transform("chars", lambda c: F.instr(F.lit(a), c).cast("double"))))
    d = d.withColumn("squares", F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda s, c: s + F.pow(F.col("n") - F.length(F.replace(F.col("own"), c, F.lit(""))), F.lit(2.0))))
    chi = (F.col("m") / F.col("n") * F.col("squares") - F.col("n") - (F.col("m") - 1)) / F.sqrt(2 * (F.col("m") - 1) * (F.col("n") - 1) / F.col("n"))

    def classes(alphabet: str) -> Column:
        total, used = F.lit(0.0), 0
        for pattern, size in (("[A-Z]", len(set(_UPPER) & set(alphabet))), ("[a-z]", len(set(_LOWER) & set(alphabet))), ("[0-9]", len(set(_DIGIT) & set(alphabet)))):
            if size:
                expected = F.col("n") * (size / len(alphabet))
                total = total + F.pow(F.regexp_count("own", F.lit(pattern)) - expected, F.lit(2.0)) / expected
                used += 1
        freedom = max(1, used - 1)
        return (F.pow(total / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / (2 / (9 * freedom)) ** 0.5  # Wilson-Hilferty

    d = d.withColumn("z_class", _of_encoding(classes))
    d = d.withColumn("bits", _of_encoding(lambda a: F.translate("own", a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))))
    d = d.withColumn("ones", F.regexp_count("bits", F.lit("1")).cast("double")).withColumn("runs", 1 + F.regexp_count("bits", F.lit("0(?=1)|1(?=0)")).cast("double"))
    pairs = 2 * F.col("ones") * (F.col("n") - F.col("ones"))
    spread = pairs * (pairs - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    z_runs = F.when(spread > 0, F.abs(F.col("runs") - 1 - pairs / F.col("n")) / F.sqrt(spread)).otherwise(F.lit(9.0))
    d = d.withColumn("mean", F.aggregate("vals", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    spread2 = F.aggregate("vals", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    shifted = F.zip_with(F.slice("vals", 1, F.size("vals") - 1), F.slice("vals", 2, F.size("vals") - 1), lambda a, b: (a - F.col("mean")) * (b - F.col("mean")))
    d = d.withColumn("v2", spread2).withColumn("v12", F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x))
    z_serial = F.when(F.col("v2") > 0, F.abs(F.col("v12") / F.col("v2") * F.sqrt("n"))).otherwise(F.lit(9.0))
    p = F.least(F.lit(1.0), 4 * F.least(_upper_tail(chi), _upper_tail(F.col("z_class")), _tail(z_runs), _tail(z_serial)))
    d = d.withColumn("p", F.when(F.col("enc").isNotNull(), p)).withColumn("natural", natural_p(F.col("v"), F.col("m"))).withColumn("band", F.least(F.lit(12), F.floor(F.log2("n") * 2) - 9).cast("int"))
    return d.drop("own", "n", "m", "chars", "vals", "squares", "z_class", "bits", "ones", "runs", "mean", "v2", "v12")


def _bin(p: Column) -> Column:
    return F.least(F.lit(120), F.floor(-2 * F.log2(F.greatest(p, F.lit(1e-40))))).cast("int")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: an array of structs (s, o, e, k), begin, kind's place, end (code points, exclusive) and kind, in order.

    Strings that the patterns name are all there; `random` ones are added where they overlap none of those. The text is read
    once; what is found is a written table, and only counts by encoding, length band and p-value bin (bounded) are shuffled.
    A null text counts as empty and has an empty array. Ids, null or repeated, are passed on, each row with its own spans; other
    columns are not read. An empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kinds = (("a", ASSIGN), ("b", ACCESS), ("c", HEX), ("r", CANDIDATE))
    d = d.select("*", *(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"{k}m") for k, p in kinds))
    d = d.select("*", *(F.when(F.size(f"{k}m") > 0, F.split("t", p, -1)).alias(f"{k}g") for k, p in kinds), F.when(F.size("am") > 0, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).alias("a2"))
    d = d.select("doc_id", "rm", "a2", *(_located(F.col(f"{k}m"), F.col(f"{k}g")).alias(k) for k, _ in kinds))
    kept = F.filter(F.zip_with("a", F.coalesce("a2", F.expr("cast(array() as array<string>)")), lambda x, v: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.length(v).alias("n"))), lambda x: x["n"] >= 6)
    named = [_named(c, o) for o, c in enumerate((kept, F.col("b"), F.col("c")))]
    # a row's number, written with it: ids may be null or repeated
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_sort(F.concat(*named)).alias("base"), F.zip_with("r", "rm", lambda x, v: F.struct(x["s"].alias("s"), x["e"].alias("e"), v.alias("v"))).alias("r"))
    found = work_table(spark, d, "secrets")

    apart = F.filter("r", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    tested = battery(found.where(F.size("r") > 0).select("row", F.explode(apart).alias("x")).select("row", "x.s", "x.e", F.col("x.v").alias("v"))).where("p is not null")
    tested = work_table(spark, tested.select("row", "s", "e", "enc", "band", (F.col("p") >= NOT_RANDOM).alias("random"), _bin(F.col("natural")).alias("bin")), "secret-tests")
    counts = tested.groupBy("enc", "band", "bin").agg(F.count(F.lit(1)).alias("c"))
    within = Window.partitionBy("enc", "band")
    ranked = counts.withColumn("above", F.sum("c").over(within.orderBy(F.desc("bin")))).withColumn("all", F.sum("c").over(within))
    # a bin's largest p-value stands for it; at most 7 encodings x 13 bands
    limits = ranked.where(F.pow(F.lit(2.0), -F.col("bin") / 2) <= FALSE_RATE * F.col("above") / F.col("all")).groupBy("enc", "band").agg(F.min("bin").alias("limit"))
    random = tested.where("random").join(F.broadcast(limits), ["enc", "band"]).where("bin >= limit")
    added = random.groupBy("row").agg(F.collect_set(F.struct(F.col("s"), F.lit(3).alias("o"), F.col("e"), F.lit(KINDS[3]).alias("k"))).alias("more"))
    out = found.select("row", "doc_id", "base").join(added, "row", "left")
    return out.select("doc_id", F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {SPAN})")))).alias("found"))


def joined(spans: Column) -> Column:
    """kind:begin:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")
