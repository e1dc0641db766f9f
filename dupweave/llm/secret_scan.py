"""Secret scan: known formats, and a randomness test battery for everything else.

Base kinds are found by pattern: `assign` (a key word, then a value of 6 or more characters), `access`
(AKIA keys of 20 or more) and `hex` (runs of 24 or more). The battery looks at every other run of 20 or
more key characters. It infers the encoding (hex, base 36, base 64), and under the hypothesis that each
symbol of that alphabet is drawn evenly and apart from the others takes a chi-squared statistic, a runs
test about the alphabet's middle and a lag-one serial correlation; all three must lie within CRITICAL
standard deviations. What passes may still be a name or a path that looks even because it is short. So it gets a
p-value as a piece of text: how likely text of as many letters has letters as rare as these, and changes as often
between capitals, small letters and digits (both as normal scores with SPREAD times the variances, since text isn't drawn letter
by letter). A step-up false-discovery rule keeps FDR among the tokens of an encoding and length band that passed the
battery: tokens that failed are decided, and don't use up the bound, however many they are. A p-value above
10^-(LEAST_EVIDENCE / 10) is never accepted.

All of it is SQL functions on arrays within a row: no Python, no shuffle of texts. The only shuffle is of
counts by (encoding, length band, evidence), a table of a fixed size that becomes one scalar map. Places come from
running sums and overlaps from blocks of spans, in about n^1.5 steps for a text's n matches.

Defined results: null and empty texts have no spans (the digest of the empty string); repeated rows each
get their spans; ties at one start go by kind in the order listed; tokens that overlap a base span are left out; an
empty table gives an empty result; input columns named like the output columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, ref

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
CRITICAL = 3.29
FDR = 0.05
BAND_WIDTH, BANDS = 8, 16
EVIDENCE_STEPS, LEAST_EVIDENCE, EVIDENCE_MOST = 10.0, 30, 1000
#: Encoding: symbols, and how often neighbours differ in kind (capital, small letter, digit) in text of these symbols.
ENCODINGS = {
    "hex": ("0123456789abcdef", 0.06),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", 0.15),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.30),
}
#: Per cent of the letters a to z in English text.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
SPREAD = 3.0
EMPTY = "array<struct<start:int,end:int,body:string,inner:int>>"


def letter_surprise(symbols: str) -> tuple[list[float], float]:
    """For each symbol the bits by which its letter surprises more than a letter of text does, 0 for others; the bits' variance in text.

    Only the letters among the symbols count, so that hex is compared with text of a to f.
    """
    used = sorted({c for c in symbols.lower() if c.isalpha()})
    share = {c: LETTERS[ord(c) - 97] / sum(LETTERS[ord(x) - 97] for x in used) for c in used}
    bits = {c: -math.log2(p) for c, p in share.items()}
    mean = sum(p * bits[c] for c, p in share.items())
    return [bits[c] - mean if c in bits else 0.0 for c in symbols.lower()], sum(p * (bits[c] - mean) ** 2 for c, p in share.items())


def symbol_kinds(symbols: str) -> list[int]:
    return [1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 0 for c in symbols]


def _let(value: Column, then) -> Column:
    """`then` of `value`, which is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array in slices of about the square root of its length."""

    def cut(values: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(values))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / size).cast("int") - 1), lambda k: F.slice(values, k * size + 1, size))

    return F.when(F.size(values) > 0, cut(values)).otherwise(F.filter(F.array(values), lambda v: F.lit(False)))


def _running_sums(numbers: Column) -> Column:
    """The sum up to each number of an array: within blocks, after the sums of the blocks before."""
    none = F.array().cast("array<int>")

    def chain(values: Column, first: Column, before: bool) -> Column:
        start = F.struct(first.cast("int").alias("at"), none.alias("out"))
        return F.aggregate(values, start, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] if before else s["at"] + v)).alias("out")), lambda s: s["out"])

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v))
        return F.flatten(F.zip_with(blocks, chain(totals, F.lit(0), True), lambda b, first: chain(b, first, False)))

    return _let(_let(numbers, _blocks), summed)


def _found(text: Column, pattern: str, inner_group: int = 0, gate: str | None = None) -> Column:
    """Leftmost matches that don't overlap, as (start, end, body, length of a group), in code points.

    `gate`: a cheaper pattern that every text with a match of interest has.

    The pieces between the matches come from split(), so no mark has to be put into the text.
    """
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inners = F.regexp_extract_all(text, F.lit(pattern), F.lit(inner_group)) if inner_group else F.array()
    matches = F.transform(bodies, lambda body, i: F.struct(body.alias("body"), F.coalesce(F.length(F.get(inners, i)), F.lit(0)).alias("inner")))
    steps = F.filter(F.zip_with(F.split(text, pattern, -1), matches, lambda piece, m: F.struct(F.length(piece).alias("gap"), m["body"].alias("body"), m["inner"].alias("inner"))), lambda m: m["body"].isNotNull())

    def placed(steps: Column) -> Column:
        ends = _running_sums(F.transform(steps, lambda m: m["gap"] + F.length(m["body"])))
        return F.zip_with(steps, ends, lambda m, end: F.struct((end - F.length(m["body"])).alias("start"), end.alias("end"), m["body"].alias("body"), m["inner"].alias("inner")))

    return F.when(text.rlike(gate or pattern), _let(steps, placed)).otherwise(F.from_json(F.lit("[]"), EMPTY))


def encoding_of(body: Column) -> Column:
    """The encoding that random bytes would need for these characters; null: not like any."""
    has = lambda p: body.rlike(p)
    letters_and_digits = has("[0-9]") & has("[A-Za-z]")
    return (
        F.when(letters_and_digits & (has("^[0-9a-f]+$") | has("^[0-9A-F]+$")), "hex")
        .when(letters_and_digits & (has("^[0-9a-z]+$") | has("^[0-9A-Z]+$")), "base36")
        .when(has("[0-9]") & has("[A-Z]") & has("[a-z]"), "base64")
    )


def _statistics(body: Column, symbols: str, rate: float) -> Column:
    """-1 if `body` fails the battery, else its evidence against text in tenths of a decade."""
    k = float(len(symbols))
    plain = F.translate(F.regexp_replace(body, "=+$", ""), "-_", "+/")
    plain = plain if k == 64 else F.lower(plain)
    codes = F.transform(F.regexp_extract_all(plain, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(symbols), c) - 1)
    surprise, variance = letter_surprise(symbols)
    surprises, kinds = (F.array(*map(F.lit, x)) for x in (surprise, symbol_kinds(symbols)))
    zero, half = F.lit(0.0), F.lit(k / 2)
    total = lambda values, f: F.aggregate(values, zero, lambda a, v: a + f(v))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)

    def sums(x: Column) -> Column:
        counts = F.transform(F.array_distinct(x), lambda d: (F.size(x) - F.size(F.array_remove(x, d))).cast("double"))
        ring = F.zip_with(x, F.concat(F.slice(x, 2, F.size(x)), F.slice(x, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        sorts = F.transform(x, lambda v: F.get(kinds, v))
        pairs = F.filter(F.zip_with(F.slice(sorts, 1, F.size(x) - 1), F.slice(sorts, 2, F.size(x)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: (p["a"] > 0) & (p["b"] > 0))
        values = {
            "n": F.size(x).cast("double"),
            "squares": total(counts, lambda c: c * c),
            "total": total(x, lambda v: v),
            "total2": total(x, lambda v: v * v),
            "lagged": total(ring, lambda v: v["a"] * v["b"]),
            "high": total(x, lambda v: flag(v >= half)),
            "turns": total(ring, lambda v: flag((v["a"] >= half) != (v["b"] >= half))),
            "letters": total(sorts, lambda v: flag((v == 1) | (v == 2))),
            "surprise": total(x, lambda v: F.get(surprises, v)),
            "pairs": F.size(pairs).cast("double"),
            "changes": total(pairs, lambda p: flag(p["a"] != p["b"])),
        }
        return F.struct(*[v.alias(name) for name, v in values.items()])

    return _let(_let(codes, sums), lambda s: _judge(s, k, rate, variance))


def _judge(s: Column, k: float, rate: float, variance: float) -> Column:
    n, low = s["n"], s["n"] - s["high"]
    uniform = (s["squares"] * (k / n) - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    # Round the ring, the number of changes has mean 2*high*low/(n-1); its variance is near the open chain's.
    both = 2 * s["high"] * low
    runs = (s["turns"] - both / (n - 1)) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
    spread = n * s["total2"] - s["total"] * s["total"]
    serial = F.when(spread > 0, ((n * s["lagged"] - s["total"] * s["total"]) / F.greatest(spread, F.lit(1e-9)) + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n).otherwise(F.lit(99.0))
    passes = (F.abs(uniform) <= CRITICAL) & (both > n) & (F.abs(runs) <= CRITICAL) & (F.abs(serial) <= CRITICAL)
    rare = s["surprise"] / F.sqrt(F.greatest(s["letters"], F.lit(1.0)) * (variance * SPREAD))
    changing = (s["changes"] - s["pairs"] * rate) / F.sqrt(F.greatest(s["pairs"], F.lit(1.0)) * (rate * (1 - rate) * SPREAD))
    z = F.greatest((rare + changing) / math.sqrt(2), F.lit(0.0))
    tail = z * z * 0.5 * 0.4342944819 + F.log10(z * 1.64 + F.sqrt(z * z * 0.76 + 4))
    evidence = F.least(F.floor(tail * EVIDENCE_STEPS), F.lit(EVIDENCE_MOST)).cast("int")
    return F.when(passes, evidence).otherwise(F.lit(-1))


def base_spans(text: Column) -> Column:
    """The spans of the known formats, in order: (start, rank, end, kind)."""
    assign = F.filter(_found(text, ASSIGN, 1), lambda s: s["inner"] >= 6)
    return F.array_sort(F.concat(*[F.transform(found, _span(rank)) for rank, found in enumerate((assign, _found(text, ACCESS), _found(text, HEX)))]))


def _span(rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"))


def _apart_from(tokens: Column, base: Column) -> Column:
    """The tokens that no span of `base` overlaps; spans are in order of their starts."""
    blocks = F.transform(_blocks(base), lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end"), b.alias("spans")))
    meet = lambda s, t: (s["start"] < t["end"]) & (t["start"] < s["end"])
    apart = lambda blocks: F.filter(tokens, lambda t: ~F.exists(blocks, lambda b: meet(b, t) & F.exists(b["spans"], lambda s: meet(s, t))))
    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), _let(blocks, apart)).otherwise(tokens)


def tested_tokens(text: Column, base: Column) -> Column:
    """Every token with an inferred encoding, apart from base spans: (start, end, stratum, evidence); evidence -1: it failed a test."""
    kind = lambda s: encoding_of(F.regexp_replace(s["body"], "=+$", ""))
    named = F.filter(F.transform(_found(text, TOKEN, gate="[0-9]"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), kind(s).alias("kind"))), lambda s: s["kind"].isNotNull())

    def judged(s: Column) -> Column:
        evidence = None
        for name, (symbols, rate) in ENCODINGS.items():
            value = _statistics(s["body"], symbols, rate)
            evidence = F.when(s["kind"] == name, value) if evidence is None else evidence.when(s["kind"] == name, value)
        band = F.least(F.floor((F.length(s["body"]) - 20) / BAND_WIDTH), F.lit(BANDS - 1)).cast("string")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat_ws(":", s["kind"], band).alias("stratum"), evidence.alias("evidence"))

    return F.transform(_let(named, lambda tokens: _apart_from(tokens, base)), judged)


def evidence_needed(tokens: DataFrame, column: str, fdr: float = FDR) -> DataFrame:
    """One row, one map: stratum -> least evidence that the step-up rule accepts.

    Of the m tokens that passed the battery, those with p <= 10^-(b/10) are accepted for the largest such p with
    m * p <= fdr * count. At most encodings x bands x evidence steps rows are left after the map-side counts.
    """
    # Outer, as Spark would otherwise put the whole battery into a filter on the array's size, too.
    each = tokens.select(F.explode_outer(column).alias("t")).filter("t.evidence >= 0").groupBy(F.col("t.stratum").alias("stratum"), F.col("t.evidence").alias("evidence")).agg(F.count(F.lit(1)).alias("n"))
    at_least = F.sum("n").over(Window.partitionBy("stratum").orderBy(F.col("evidence").desc()))
    all_of = F.sum("n").over(Window.partitionBy("stratum"))
    accepted = each.select("stratum", "evidence", at_least.alias("accepted"), all_of.alias("m")).filter(F.col("evidence") >= LEAST_EVIDENCE).filter(F.col("m") * F.pow(F.lit(10.0), -F.col("evidence") / EVIDENCE_STEPS) <= F.lit(fdr) * F.col("accepted"))
    least = accepted.groupBy("stratum").agg(F.min("evidence").alias("evidence"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "evidence"))).alias("needed"))


def scan_secrets(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """`docs` with `secrets`: array of (start, rank, end, kind), in order; rank is the kind's place in KINDS."""
    text = F.coalesce(ref(text_col), F.lit(""))
    p = fresh(docs, "scan")
    base, tokens, limits = (F.col(f"{p}{c}") for c in ("base", "tokens", "limits"))
    spanned = docs.withColumn(f"{p}base", base_spans(text)).withColumn(f"{p}tokens", tested_tokens(text, base))
    needed = evidence_needed(spanned.select(f"{p}tokens"), f"{p}tokens", fdr).scalar()
    new = F.filter(tokens, lambda t: t["evidence"] >= F.try_element_at(limits, t["stratum"]))
    kept = [ref(c) for c in docs.columns if c.lower() != "secrets"]
    return spanned.withColumn(f"{p}limits", needed).select(*kept, F.array_sort(F.concat(base, F.transform(new, _span(3)))).alias("secrets"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """The query's columns."""
    found = scan_secrets(docs, **options)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))
