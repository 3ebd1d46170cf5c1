"""Personal data: high-recall candidates, boosted trees over their format and context, calibrated thresholds.

Everything on the main path is Spark functions. Base spans are found by four patterns and their
checks. Generators with high recall propose further, overlapping candidates: runs of digits and
number punctuation, address-like words with written-out signs, account numbers, long random
strings, and values given to a key that speaks of a secret. Each candidate is described by binned
features of its format and of what stands around it.

Labels are seeds that the base patterns do not decide. A candidate is a positive example if its own
check holds (card digit, account remainder, an address once its signs are written back), which no feature shows, or if the words before it name such data and its form fits; one whose check fails and
that nothing announces is a negative one. The features are few and binned, so the whole corpus of
candidates is counted exactly in a table of cells, one row a cell and fold, which the product of
the features' values bounds; trees are boosted on one fold of that table, and each kind's threshold is
the lowest one whose precision among that kind's candidates on the other fold is high enough; a kind with too few of them adds nothing. The trees go back into the plan
as a CASE expression. Candidates at or above the threshold that overlap no base span are added
as spans of their own kinds; base spans always stay.

Positions are code points, ends exclusive. Possessive quantifiers and the start conditions in
the patterns change no match: they only keep the search from going over long runs twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read

# The base patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched at all.
SIGNS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Words that a secret's value follows; generator and guard share them.
_KEYS = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?)[\"']?\x20{0,2}[:=]"
GENERATORS = {
    "number": r"(?:\G|(?<![0-9().+-]))[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "address": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "account": r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,7}+(?:[\x20-]?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "random": r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}+={0,2}+",
    "value": rf"(?i)(?<![a-z]){_KEYS}\x20{{0,2}}[\"']?+[^\s\"',;|]{{6,}}+",
}
GENERATOR_SIGNS = {
    "number": r"[0-9][^A-Za-z\n]{0,12}[0-9]",
    "address": r"@|[\[(]at[\])]",
    "account": r"[A-Z]{2}[0-9]{2}[\x20-]?[A-Z0-9]{4}",
    "random": r"[A-Za-z0-9+/_-]{20}",
    "value": rf"(?i){_KEYS}",
}
#: Words before a candidate that speak of personal data, and of secrets.
HINTS = r"(?i)(?:mail|contact|tel|phone|call|fax|mobile|card|visa|iban|account|ssn|passport)[^A-Za-z]{0,12}$"
SECRETS = r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|bearer|auth|credentials?)[^A-Za-z]{0,6}$"

ROUNDS, DEPTH, RATE, PRECISION, LEAST_SUPPORT = 24, 3, 0.3, 0.98, 5
#: The features and how many values each has: the product bounds the number of cells.
FEATURES = {"kind": 5, "digits": 7, "marks": 6, "plus": 2, "joined": 2, "hint": 3, "given": 2, "size": 4, "mixed": 3}
#: Matches of one text whose positions are summed up at once; their arrays are joined afterwards.
RUN = 64


def _found(text: Column, pattern: str, sign: str) -> Column:
    """array<struct<start, end, s, before, after>> of the leftmost non-overlapping matches.

    The text is cut at the matches; positions are running sums over pieces and matches."""
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"), pieces.alias("before"), F.slice(pieces, 2, 1 << 30).alias("after"))
    return F.when(text.rlike(sign), F.filter(zipped, lambda x: x["s"].isNotNull()))


def _placed(zipped: Column, fine) -> Column:
    """Start and end for the matches that pass `fine`; the others only move the position on.

    Running sums go over RUN matches at a time, so that a text with very many of them does not
    copy its list of spans once for each."""
    span = "struct<start:int,end:int,s:string,before:string,after:string>"
    none, nothing = F.array().cast(f"array<{span}>"), F.array().cast(f"array<array<{span}>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["s"])
        own = F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s"), F.right(x["before"], F.lit(24)).alias("before"), F.left(x["after"], F.lit(2)).alias("after"))
        return F.struct(end.alias("at"), F.when(fine(x["s"]), F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    def run(acc, part):
        own = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))[0]

    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(zipped), F.lit(1)), F.lit(RUN)), lambda i: F.slice(zipped, i, RUN))
    placed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("out")), run, lambda acc: F.flatten(acc["out"]))
    return F.coalesce(F.when(F.size(zipped) > 0, placed), none)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """The check of card numbers: every second digit from the right counts double, less 9 above 9."""
    digits = F.split(F.reverse(_digits(s)), "(?<=[0-9])(?=[0-9])")
    double = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))
    return F.aggregate(double, F.lit(0), lambda a, d: a + d) % 10 == 0


def _part_fits(p: Column) -> Column:
    bare = F.regexp_replace(p, "^0+", "")
    return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))


CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s, r"\."), _part_fits),
    "card": lambda s: F.when(F.length(_digits(s)).between(13, 19), _luhn(s)).otherwise(F.lit(False)),
    "phone": lambda s: F.length(_digits(s)).between(9, 15),
}


def _remainder(s: Column) -> Column:
    """What is left of an account number by 97, its first four signs last and letters as 10 to 35."""
    bare = F.regexp_replace(s, "[^A-Z0-9]", "")
    signs = F.split(F.concat(F.substring(bare, 5, 1 << 20), F.left(bare, F.lit(4))), "(?<=[A-Z0-9])(?=[A-Z0-9])")
    return F.aggregate(signs, F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _valid(kind: str, s: Column) -> Column:
    """The candidate's own check."""
    if kind == "number":
        return F.when(F.length(_digits(s)).between(13, 19), _luhn(s)).otherwise(F.lit(False))
    if kind == "account":
        return _remainder(s) == 1
    if kind == "address":
        plain = F.regexp_replace(F.regexp_replace(s, r"\x20?[\[(]at[\])]\x20?", "@"), r"\x20?[\[(]dot[\])]\x20?", ".")
        return plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
    return s.rlike("[0-9]") & s.rlike("[A-Za-z]")


def spans_and_candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(id, email, ip, card, phone, number, ...): arrays of placed matches, one row a document;
    with `carry` also `doc`, a struct of all its columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = ["id", "doc"] if carry else ["id"]
    out = docs.select(F.col(id_col).alias("id"), t.alias("t"), *([F.struct(*(F.col(c) for c in docs.columns)).alias("doc")] if carry else []))
    zips = {k: _found(F.col("t"), p, SIGNS[k]) for k, p in PATTERNS.items()}
    more = {k: _found(F.col("t"), p, GENERATOR_SIGNS[k]) for k, p in GENERATORS.items()}
    out = out.select(*kept, *(c.alias(k) for k, c in zips.items()), *(c.alias(k) for k, c in more.items()))
    base = [_placed(F.col(k), CHECKS[k]).alias(k) for k in PATTERNS]
    always = lambda s: F.lit(True)
    return out.select(*kept, *base, *(_placed(F.col(k), always).alias(k) for k in GENERATORS))


def _features(c: Column, kind: str) -> list[Column]:
    s, d = c["s"], F.length(_digits(c["s"]))
    marks = F.regexp_replace(s, "[A-Za-z0-9_+%]", "")
    binned = {
        "kind": F.lit(list(GENERATORS).index(kind)),
        "digits": F.when(d < 7, 0).when(d < 9, 1).when(d < 13, 2).when(d < 16, 3).when(d == 16, 4).when(d < 20, 5).otherwise(6),
        "marks": F.when(marks == "", 0).when(marks.rlike(r"^\.+$"), 1).when(marks.rlike(r"^ +$"), 2).when(marks.rlike("^-+$"), 3).when(marks.rlike(r"^@\.+$"), 4).otherwise(5),
        "plus": s.startswith("+").cast("int"),
        "joined": (c["before"].rlike(r"[\p{L}0-9_]$") | c["after"].rlike(r"^[\p{L}0-9_]")).cast("int"),
        "hint": F.when(c["before"].rlike(SECRETS), 2).when(c["before"].rlike(HINTS), 1).otherwise(0),
        "given": c["before"].rlike(r"[:=]\x20{0,2}[\"']?$").cast("int"),
        "size": F.when(F.length(s) < 10, 0).when(F.length(s) < 16, 1).when(F.length(s) < 24, 2).otherwise(3),
        # letters and digits in turns, as chance deals them: often, sometimes, or hardly ever
        "mixed": F.when(F.size(F.split(s, "(?<=[A-Za-z])(?=[0-9])")) > 4, 2).when(F.size(F.split(s, "(?<=[A-Za-z])(?=[0-9])")) > 1, 1).otherwise(0),
    }
    return [F.coalesce(binned[f].cast("int"), F.lit(0)).alias(f) for f in FEATURES]


def _seed(kind: str, c: Column, valid: Column) -> Column:
    """Whether the candidate is a positive example."""
    digits = F.length(_digits(c["s"]))
    if kind == "number":
        return valid | (digits.between(9, 15) & c["s"].startswith("+")) | (digits.between(7, 15) & c["before"].rlike(HINTS))
    if kind == "random":
        return valid & c["before"].rlike(SECRETS)
    return valid


def described(found: DataFrame) -> DataFrame:
    """found with `candidates`: array<struct<start, end, name, features..., held, seed>>."""
    base = F.concat(*(F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in PATTERNS))
    out = found.withColumn("base", base)

    def of(kind: str) -> Column:
        def one(c: Column) -> Column:
            held = F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            seed = F.coalesce(_seed(kind, c, _valid(kind, c["s"])), F.lit(False))
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(kind).alias("name"), *_features(c, kind), held.alias("held"), seed.alias("seed"))

        return F.transform(kind, one)

    return out.select(*(c for c in ("id", "doc") if c in found.columns), *PATTERNS, F.concat(*map(of, GENERATORS)).alias("candidates"))


def cells(table: DataFrame) -> list[tuple[tuple[int, ...], int, int, int]]:
    """(features, fold, positives, candidates) for every cell that occurs: at most 2 x the product of FEATURES rows."""
    each = table.select(F.pmod(F.xxhash64("id"), F.lit(2)).alias("fold"), F.explode("candidates").alias("c")).select("fold", "c.*")
    rows = each.groupBy(*FEATURES, "fold").agg(F.sum(F.col("seed").cast("long")).alias("yes"), F.count("*").alias("n")).collect()
    return [(tuple(r[f] for f in FEATURES), r.fold, r.yes, r.n) for r in rows]


def _split(rows: list[tuple], depth: int):
    """A regression tree over (features, gradient, weight) rows: nested (feature, value, left, right) or a leaf's step."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, gain = None, 1e-6
    for f, values in enumerate(FEATURES.values() if depth else ()):
        sums = [[0.0, 0.0] for _ in range(values)]
        for x, dg, dh in rows:
            sums[x[f]][0] += dg
            sums[x[f]][1] += dh
        gl = hl = 0.0
        for v in range(values - 1):
            gl, hl = gl + sums[v][0], hl + sums[v][1]
            now = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if 0 < hl < h and now > gain:
                best, gain = (f, v), now
    if best is None:
        return RATE * g / (h + 1)
    f, v = best
    return (f, v, _split([r for r in rows if r[0][f] <= v], depth - 1), _split([r for r in rows if r[0][f] > v], depth - 1))


def _value(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        f, v, low, high = tree
        tree = low if x[f] <= v else high
    return tree


def boost(table: list[tuple], rounds: int = ROUNDS, depth: int = DEPTH) -> tuple[float, list]:
    """(start, trees) by Newton steps of the logistic loss over counted cells."""
    yes, n = sum(r[2] for r in table), sum(r[3] for r in table)
    start = math.log((yes + 1) / (n - yes + 1))
    score, trees = [start] * len(table), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        trees.append(_split([(x, y - c * q, c * q * (1 - q)) for (x, _, y, c), q in zip(table, p, strict=True)], depth))
        score = [s + _value(trees[-1], r[0]) for s, r in zip(score, table, strict=True)]
    return start, trees


def threshold(table: list[tuple], start: float, trees: list, precision: float = PRECISION) -> float:
    """The lowest score above which the table's candidates reach the precision at every higher
    score too, with enough of them; infinite where none does."""
    scored = sorted(((start + sum(_value(t, x) for t in trees), y, n) for x, _, y, n in table), reverse=True)
    yes = n = 0
    found = math.inf
    for k, (s, y, c) in enumerate(scored):
        yes, n = yes + y, n + c
        if k + 1 < len(scored) and scored[k + 1][0] == s:
            continue
        if yes < precision * n:
            break
        if n >= LEAST_SUPPORT:
            found = s
    return found


def _as_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, v, low, high = tree
    return F.when(c[list(FEATURES)[f]] <= v, _as_column(low, c)).otherwise(_as_column(high, c))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(id, email, ip, card, phone, added): arrays of struct<kind, start, end> in order, one row a
    document; with `carry` also `doc`, a struct of its columns as they were.

    A null text is empty and has no spans; rows that repeat, and rows with a null id, keep a row
    each; other columns are not read; an empty table gives no rows and learns nothing, so that
    nothing is added. An added span that lies inside another one is left out.
    """
    table = durable(described(spans_and_candidates(docs, id_col, text, carry)), "pii")
    counted = cells(table)
    start, trees = boost([r for r in counted if r[1] == 0])
    held = [r for r in counted if r[1] == 1]
    of = lambda k: threshold([r for r in held if r[0][0] == k], start, trees) - 1e-9  # noqa: E731  sums may round otherwise in the plan
    least = {kind: limit for k, kind in enumerate(GENERATORS) if (limit := of(k)) < math.inf}

    def score(c: Column) -> Column:
        total = F.lit(start)
        for t in trees:
            total = total + _as_column(t, c)
        return total

    def spans(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias(kind)

    def passes(c: Column) -> Column:
        limit = F.lit(math.inf)
        for kind, value in least.items():
            limit = F.when(c["name"] == kind, value).otherwise(limit)
        return score(c) >= limit

    new = F.filter("candidates", lambda c: ~c["held"] & passes(c)) if least else F.slice(F.col("candidates"), 1, 0)
    table = table.withColumn("new", F.transform(new, lambda c: F.struct(c["name"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    wider = lambda c, o: (o["start"] <= c["start"]) & (o["end"] >= c["end"]) & ((o["end"] - o["start"] > c["end"] - c["start"]) | ((o["end"] - o["start"] == c["end"] - c["start"]) & (o["kind"] < c["kind"])))
    added = F.sort_array(F.filter("new", lambda c: ~F.exists("new", lambda o: wider(c, o))))
    return table.select(*(c for c in ("id", "doc") if c in table.columns), *map(spans, PATTERNS), added.alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span's text replaced by its kind in brackets. Rows travel whole, so repeated
    and null ids and any column names are fine.

    Of spans that overlap, the first one's kind stands for their union."""
    by_place = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    found = find(docs, id_col, text, carry=True).select("doc", F.array_sort(F.concat(*PATTERNS, "added"), by_place).alias("spans"))
    body = F.coalesce(F.col("doc")[text], F.lit(""))

    def step(acc, x):
        fresh_part = F.when(x["start"] >= acc["at"], F.concat(F.substring(body, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], fresh_part).alias("out"))

    whole = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    redacted = F.when(F.size("spans") > 0, whole).otherwise(F.col("doc")[text])
    return found.select(*(redacted.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest. The counts are of base spans; added spans have kinds of their own, after the base kinds."""
    out = find(read(spark, sf_dir, "documents"))
    base = F.concat(*PATTERNS)
    return out.select(
        F.col("id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, F.col("added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"), (F.size(base) + F.size("added")).cast("long").alias("n_spans"),
    )
