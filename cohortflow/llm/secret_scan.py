"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests tells from ordinary text. Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import let, text_of, written

# Patterns of the base kinds, in the order in which kinds are listed, with the group that is measured and its least length.
BASE_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
RANDOM = "random"
#: The same matches where short ones only cost time: a run that is too short has no long part.
_SCANNED = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

# Encodings by their alphabets (most specific first), and the share of equal pairs that ordinary text has when it
# is written with them: letters of running text at least 0.06, digits for hexadecimal 0.1.
ENCODINGS = [
    ("hex", "0123456789abcdef", 0.1),
    ("HEX", "0123456789ABCDEF", 0.1),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.06),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.06),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.06),
]
#: Changes between lower case, upper case, digits and signs, per pair of neighbours, that identifiers may show.
CLASS_CHANGES = 0.25
BLOCK = 256


def _scan(values: Column) -> Column:
    """Sums of what stands before each value of a short array."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def sums_before(values: Column) -> Column:
    """Sums of what stands before each value (long); in blocks, so that long arrays are not copied for every value."""

    def blocked(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))

        def joined(bs: Column) -> Column:
            offsets = _scan(F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)))
            return let(offsets, lambda off: F.flatten(F.transform(bs, lambda b, i: F.transform(_scan(b), lambda v: v + F.get(off, i)))))

        return let(blocks, joined)

    return let(values.cast("array<bigint>"), blocked)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches that do not overlap: array of (start, end, token, measured); code points, end exclusive.

    What stands between the matches, together with the matches, gives their places.
    """

    def located(tokens: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("long"))
        sizes = F.transform(tokens, lambda t: F.length(t).cast("long"))
        measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else tokens

        def spans(both: Column) -> Column:
            return F.transform(tokens, lambda t, i: F.struct(
                (F.get(both["before"], i) + F.get(both["gaps"], i)).alias("start"), (F.get(both["before"], i) + F.get(both["gaps"], i) + F.length(t)).alias("end"), t.alias("token"), F.get(both["measured"], i).alias("measured")))

        before = sums_before(F.zip_with(F.slice(gaps, 1, F.size(tokens)), sizes, lambda g, s: g + s))
        return let(F.struct(before.alias("before"), gaps.alias("gaps"), measured.alias("measured")), spans)

    empty = F.array().cast("array<struct<start:bigint,end:bigint,token:string,measured:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda tokens: F.when(F.size(tokens) > 0, located(tokens)).otherwise(empty))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds: array of (start, kind_no, end, kind), sorted."""

    def of_kind(number: int, kind: str, pattern: str, group: int, least: int) -> Column:
        good = F.filter(found(text, _SCANNED.get(kind, pattern), group), lambda m: F.length(m["measured"]) >= least)
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    kinds = [of_kind(number, *kind) for number, kind in enumerate(BASE_KINDS)]
    return F.sort_array(F.concat(*kinds))


def upper_tail(z: Column) -> Column:
    """Probability of a standard normal value above z; within 0.3 % of it everywhere (Boerjesson and Sundberg's fraction)."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / (2.5066282746310002 * (0.661 * x + 0.339 * F.sqrt(x * x + 5.51)))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """Tests of one token in its inferred encoding: struct of encoding, length, p_random, p_text (null encoding: none fits).

    Under randomness: chi-squared against a uniform alphabet, runs around the middle of the alphabet, serial correlation of
    neighbours; p_random is the smallest of the three, times three. Under ordinary text: the chi-squared value follows a
    non-central law that grows with the length, and character classes change rarely; both combine into p_text. Longer tokens
    have more power by both.
    """
    bare = F.rtrim(token, F.lit("="))
    encoding = F.coalesce(*[F.when(bare.rlike("^[" + alphabet.replace("-", r"\-") + "]+$"), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), F.lit(len(alphabet)).alias("letters"), F.lit(equal).alias("equal"))) for name, alphabet, equal in ENCODINGS])

    def counted(e: Column) -> Column:
        letters = F.filter(F.split(bare, "", -1), lambda c: c != "")
        index = F.transform(letters, lambda c: (F.instr(e["alphabet"], c) - 1).cast("long"))
        return F.struct(e.alias("e"), index.alias("x"), F.sort_array(index).alias("sorted"), F.transform(letters, lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)).alias("kinds"))

    def summed(c: Column) -> Column:
        zero = F.lit(0).cast("long")
        runs = F.struct(F.lit(-1).cast("long").alias("last"), zero.alias("run"), zero.alias("squares"))
        squares = F.aggregate(c["sorted"], runs, lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(1).alias("run"), (a["squares"] + F.when(x == a["last"], 2 * a["run"] + 1).otherwise(1)).alias("squares")), lambda a: a["squares"])
        start = F.struct(F.lit(-1).cast("long").alias("last"), zero.alias("first"), zero.alias("sum"), zero.alias("sum2"), zero.alias("product"), zero.alias("high"), zero.alias("runs"))

        def step(a: Column, x: Column) -> Column:
            side = lambda v: 2 * v >= c["e"]["letters"]
            first = a["last"] < 0
            return F.struct(
                x.alias("last"), F.when(first, x).otherwise(a["first"]).alias("first"), (a["sum"] + x).alias("sum"), (a["sum2"] + x * x).alias("sum2"), (a["product"] + F.when(first, 0).otherwise(a["last"] * x)).alias("product"),
                (a["high"] + side(x).cast("long")).alias("high"), (a["runs"] + F.when(first | (side(x) != side(a["last"])), 1).otherwise(0)).alias("runs"))

        changes = F.aggregate(c["kinds"], F.struct(F.lit(-1).alias("last"), zero.alias("n")), lambda a, k: F.struct(k.alias("last"), (a["n"] + F.when((a["last"] >= 0) & (a["last"] != k), 1).otherwise(0)).alias("n")), lambda a: a["n"])
        return F.struct(c["e"].alias("e"), F.size(c["x"]).cast("double").alias("n"), squares.cast("double").alias("squares"), F.aggregate(c["x"], start, step).alias("s"), changes.cast("double").alias("changes"))

    def judged(v: Column) -> Column:
        n, s, letters = v["n"], v["s"], v["e"]["letters"].cast("double")
        free = letters - 1
        chi = letters * v["squares"] / n - n
        cube = 2 / (9 * free)
        z_chi = (F.pow(chi / free, F.lit(1 / 3)) - (1 - cube)) / F.sqrt(cube)
        high, low = s["high"].cast("double"), n - s["high"].cast("double")
        expected_runs = 2 * high * low / n + 1
        spread = (expected_runs - 1) * (expected_runs - 2) / (n - 1)
        z_runs = F.when(spread > 0, (s["runs"] - expected_runs) / F.sqrt(spread)).otherwise(-F.sqrt(n))
        mean = s["sum"] / n
        variance = s["sum2"] - n * mean * mean
        between = s["product"] - mean * (2 * s["sum"] - s["first"] - s["last"]) + (n - 1) * mean * mean
        z_serial = F.when(variance > 0, (between / variance + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        p_random = F.least(F.lit(1.0), 3 * F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial))))
        shift = n * (letters * v["e"]["equal"] - 1)
        z_even = (free + shift - chi) / F.sqrt(2 * (free + 2 * shift))
        z_change = (v["changes"] - (n - 1) * CLASS_CHANGES) / F.sqrt((n - 1) * CLASS_CHANGES * (1 - CLASS_CHANGES))
        return F.struct(v["e"]["name"].alias("encoding"), n.cast("int").alias("length"), p_random.alias("p_random"), upper_tail((z_even + z_change) / F.lit(2.0 ** 0.5)).alias("p_text"))

    nothing = F.lit(None).cast("struct<encoding:string,length:int,p_random:double,p_text:double>")
    return let(encoding, lambda e: F.when(e.isNull() | (F.length(bare) < 2), nothing).otherwise(let(counted(e), lambda c: let(summed(c), judged))))


def false_discovery_levels(counts: list[tuple[str, int, int]], rate: float) -> dict[str, int]:
    """Per stratum the lowest level that the step-up rule of Benjamini and Hochberg lets through; counts are (stratum, level, tokens).

    Level g stands for p-values up to 10^(-g/10), to which they are rounded up, so the rule stays valid on the grid.
    """
    by: dict[str, dict[int, int]] = {}
    for stratum, level, n in counts:
        by.setdefault(stratum, {})[level] = n
    out = {}
    for stratum, levels in by.items():
        total, passed = sum(levels.values()), 0
        for level in sorted(levels, reverse=True):
            passed += levels[level]
            if 10 ** (-level / 10) <= rate * passed / total:
                out[stratum] = level
    return out


def scan_secrets(docs: DataFrame, min_token: int = 20, alpha: float = 0.001, rate: float = 0.01) -> DataFrame:
    """doc_id, spans: array of (start, kind_no, end, kind), sorted by place, of every row of `docs`.

    Base kinds are patterns. Kind `random` adds runs of at least `min_token` letters of encoded data, also right after an equals sign, that no base span holds:
    the battery must not reject randomness at `alpha`, and ordinary text must be rejected under false-discovery control at
    `rate`. The control runs over all tokens of the corpus, apart for each encoding and doubling of the length. Only counts per
    stratum and level of p reach the driver: at most a few thousand rows, whatever the input. Texts are read once; their
    spans and token levels are written in between.

    Null or empty text: no spans. Null doc_id: kept. Repeated rows: each scanned, and each counted by the control. Equal
    places: kinds in their listed order, `random` last. Empty table: empty result. Very long texts: whole, in linear time.
    Other columns are not read.
    """
    text = text_of()
    tokens = F.transform(found(text, "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % min_token), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["token"]).alias("b")))

    def levelled(m: Column) -> Column:
        b = m["b"]
        level = F.when(b["p_random"] < alpha, 0).otherwise(F.floor(-10 * F.log10(F.greatest(b["p_text"], F.lit(1e-30))))).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(b["encoding"], F.lit(":"), F.floor(F.log2(b["length"].cast("double"))).cast("string")).alias("stratum"), level.alias("level"))

    scanned = docs.select(F.col("doc_id"), base_spans(text).alias("base"), tokens.alias("tokens"))
    scanned = written(scanned.select("doc_id", "base", F.transform(F.filter("tokens", lambda m: m["b"].isNotNull()), levelled).alias("tokens")), "scanned")
    counts = scanned.select(F.inline("tokens")).groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"))
    levels = false_discovery_levels([tuple(r) for r in counts.collect()], rate)
    least = F.create_map(*[F.lit(x) for pair in sorted(levels.items()) for x in pair]) if levels else F.create_map(F.lit(""), F.lit(0))
    number = len(BASE_KINDS)

    def secret(m: Column) -> Column:
        return (m["level"] >= F.element_at(least, m["stratum"])) & ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))

    random = F.transform(F.filter("tokens", secret), lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind_no"), m["end"].alias("end"), F.lit(RANDOM).alias("kind")))
    return scanned.select("doc_id", F.sort_array(F.concat("base", random)).alias("spans"))


def joined_spans(spans: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """kind:start:end of all spans, or of those to keep, joined by commas."""
    chosen = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
