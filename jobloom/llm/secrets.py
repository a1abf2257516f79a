"""Secret scan: fixed patterns, and a randomness test battery. DataFrame functions only.

Base patterns (``assign``, ``access``, ``hex``) are matched leftmost and without
overlap. The battery looks at all long runs of code characters, infers their encoding
(hex, base32 and base36 in one case, else base64), and puts the symbols to three tests:
chi-squared uniformity over the alphabet, runs above and below its middle, and serial
correlation. A run of characters is random if none of the three rejects uniformity
(Bonferroni). How likely ordinary text is to look so comes from the same tests: each
statistic's likelihood under random symbols over that under a text model of the
encoding, which grows with length (chi-squared of a text's coincidences; shifted runs
and correlation), and the same ratio for the changes between character classes, whose
mean with the runs and the correlation multiplies that of chi-squared. Under a text
model such a ratio exceeds x with a chance of at most 1 / x, so 1 over it is ranked as
the p-value of text; this holds as far as the model does (normal statistics,
composition independent of order). Within each band of lengths, over all candidates of
all documents, the Benjamini-Hochberg rule on it controls the share of false
discoveries under that model. Discoveries that overlap a base span are left out; base
spans always stay.

Positions are code points, ends exclusive. Defined results: a null text is empty
and has no spans; whole texts are scanned, and the work on one text grows with its
matches to the power of 1.5 at most; repeated rows are scanned each for itself; with no
candidate nothing is discovered; columns of the input named ``base`` or ``spans`` are
replaced, others are kept as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough matches whole, and a shorter one holds no longer one, so the
#: least length can stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Level of each test of randomness, and the share of false discoveries.
TEST_LEVEL = 0.01
FALSE_SHARE = 0.01
#: Changes between character classes a character, in ordinary identifiers and words, and in random symbols.
TEXT_CHANGES = 0.08
RANDOM_CHANGES = {"hex": 0.469, "base32": 0.305, "base36": 0.401, "base64": 0.645}
#: In text: two symbols are the same (hex: as for random ones; base36: words with digits; base64: words of both cases with digits).
TEXT_SAME = {"hex": 1 / 16, "base32": 0.066, "base36": 0.06, "base64": 0.044}
#: In text: runs and serial correlation, over the root of the length, are off by this to one side.
TEXT_ORDER = 0.13
BANDS = (32, 64)
MAX_BITS = 400
_ALPHABET = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def _matches(text: str, pattern: str) -> str:
    """SQL: an array of (start, end, token) of all matches of a pattern.

    A fold that appends copies its array, so it runs over pieces of about the root of the
    number of matches, which are then moved to their places.
    """
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    none = "cast(array() as array<struct<start:int,end:int,token:string>>)"
    pairs = f"zip_with(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0), (gap, hit) -> struct(gap, hit))"
    fold = f"""aggregate(piece, named_struct('at', 0, 'out', {none}),
      (acc, x) -> named_struct('at', acc.at + char_length(x.gap) + char_length(x.hit), 'out', array_append(acc.out, named_struct('start', acc.at + char_length(x.gap), 'end', acc.at + char_length(x.gap) + char_length(x.hit), 'token', x.hit))))"""
    let = lambda name, value, then: f"transform(array({value}), {name} -> {then})[0]"
    pieces = "transform(sequence(0, (size(all) - 1) div c), j -> slice(all, j * c + 1, c))"
    moved = let("base", "aggregate(slice(folded, 1, j), 0, (acc, y) -> acc + y.at)", "transform(x.out, m -> named_struct('start', m.start + base, 'end', m.end + base, 'token', m.token))")
    placed = let("folded", f"transform({pieces}, piece -> {fold})", f"flatten(transform(folded, (x, j) -> {moved}))")
    return let("all", pairs, f"case when size(all) > 0 then {let('c', 'cast(ceil(sqrt(size(all))) as int)', placed)} else {none} end")


def _found(pattern: str) -> Column:
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    none = "cast(array() as array<struct<start:int,end:int,token:string>>)"
    return F.expr(f"case when _text rlike {p} then {_matches('_text', pattern)} else {none} end")


def _p_two_sided(z: str) -> str:
    """SQL: two-sided p of a normal statistic (tanh form of the distribution function)."""
    return f"(1 - tanh(sqrt(2 / pi()) * (abs({z}) + 0.044715 * pow(abs({z}), 3))))"


def _per_code(values: dict[str, float]) -> str:
    return "case _code " + " ".join(f"when '{k}' then {v}D" for k, v in values.items()) + " end"


def _order_bits(z: str) -> str:
    """SQL: bits for random over text of a normal statistic, against the nearer side."""
    return f"({TEXT_ORDER**2 / 2} * _n - {TEXT_ORDER} * sqrt(_n) * abs({z})) / ln(2D)"


_HALF = "concat(repeat('0', cast(_a / 2 as int)), repeat('1', cast(_a / 2 as int)))"
_CLASSES = "translate(_token, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-_', '" + "L" * 26 + "U" * 26 + "D" * 10 + "S" * 4 + "')"
for _k in "LUDS":
    _CLASSES = f"regexp_replace({_CLASSES}, '{_k}+', '{_k}')"
#: The tests, step by step: each names a field and the SQL that gives it from the fields before.
STEPS = {
    # encoding and symbols
    "_code": "case when _token rlike '^[0-9a-f]+$' or _token rlike '^[0-9A-F]+$' then 'hex' when _token rlike '^[A-Z2-7]+$' or _token rlike '^[a-z2-7]+$' then 'base32' when _token rlike '^[A-Z0-9]+$' or _token rlike '^[a-z0-9]+$' then 'base36' else 'base64' end",
    "_abc": "case _code " + " ".join(f"when '{k}' then '{v}'" for k, v in _ALPHABET.items()) + " end",
    "_sym": "case _code when 'hex' then lower(_token) when 'base64' then translate(_token, '-_', '+/') else upper(_token) end",
    "_n": "cast(length(_sym) as double)",
    "_a": "cast(length(_abc) as double)",
    # chi-squared uniformity over the alphabet
    "_chi": "aggregate(split(_abc, ''), 0D, (acc, s) -> acc + pow(_n - length(replace(_sym, s, '')), 2)) * _a / _n - _n",
    "_z1": "greatest((_chi - (_a - 1)) / sqrt(2 * (_a - 1) * (1 - 1 / _n)), 0D)",
    # runs above and below the middle of the alphabet
    "_side": f"translate(_sym, _abc, {_HALF})",
    "_ones": "cast(length(replace(_side, '0', '')) as double)",
    "_runs": "1 + (2 * _n - length(replace(_side, '01', '')) - length(replace(_side, '10', ''))) / 2",
    "_mean": "2 * _ones * (_n - _ones) / _n + 1",
    "_z2": "case when _ones = 0 or _ones = _n then 99D else (_runs - _mean) / sqrt(greatest((_mean - 1) * (_mean - 2) / (_n - 1), 1e-9D)) end",
    # serial correlation
    "_x": "transform(split(_sym, ''), s -> cast(locate(s, _abc) - 1 as double))",
    "_s": "aggregate(_x, 0D, (acc, v) -> acc + v) / _n",
    "_q": "aggregate(_x, 0D, (acc, v) -> acc + v * v) - _n * _s * _s",
    "_lag": "aggregate(zip_with(slice(_x, 1, size(_x) - 1), slice(_x, 2, size(_x) - 1), (u, v) -> (u - _s) * (v - _s)), 0D, (acc, v) -> acc + v)",
    "_z3": "case when _q <= 0 then 99D else (_lag / _q + 1 / _n) * sqrt(_n) end",
    "_p": f"least({_p_two_sided('_z1')}, {_p_two_sided('_z2')}, {_p_two_sided('_z3')})",
    "_random": f"3 * _p >= {TEST_LEVEL}",
    # bits for random symbols over text, by each test and by changes between character classes
    "_over": f"greatest(_a * {_per_code(TEXT_SAME)} - 1, 0D) * (_n - 1)",
    "_b1": "(0.5 * ln(1 + 2 * _over / (_a - 1)) - pow(_chi - (_a - 1), 2) / (4 * (_a - 1)) + pow(_chi - (_a - 1) - _over, 2) / (4 * (_a - 1 + 2 * _over))) / ln(2D)",
    "_b2": _order_bits("_z2"),
    "_b3": _order_bits("_z3"),
    "_rate": _per_code(RANDOM_CHANGES),
    "_changes": f"cast(length({_CLASSES}) - 1 as double)",
    "_b4": f"_changes * log2(_rate / {TEXT_CHANGES}) + (_n - 1 - _changes) * log2((1 - _rate) / (1 - {TEXT_CHANGES}))",
    "_bits": f"cast(greatest(0, least({MAX_BITS}, floor(_b1 + log2((pow(2D, least(_b2, {MAX_BITS})) + pow(2D, least(_b3, {MAX_BITS})) + pow(2D, least(_b4, {MAX_BITS}))) / 3)))) as int)",
}
#: Fields that later steps still need, besides the token and its place.
_LAST_USE = {n: max([i for i, e in enumerate(STEPS.values()) if re.search(rf"{n}\b", e)], default=len(STEPS)) for n in STEPS}


def _tested(text: DataFrame) -> DataFrame:
    """``_found``: the long runs of code characters of each text, with their tests."""
    out = text.withColumn("_found", _found(CANDIDATE))
    out = out.withColumn("_found", F.expr("transform(_found, r -> named_struct('start', r.start, 'end', r.end, '_token', r.token))"))
    have = ["start", "end", "_token"]
    for i, (name, sql) in enumerate(STEPS.items()):
        sql = re.sub(r"(?<![\w.])(_[a-z]\w*)", lambda m: f"r.{m[1]}", sql)
        have = [h for h in have if _LAST_USE.get(h, len(STEPS)) >= i]
        fields = ", ".join(f"'{h}', r.{h}" for h in have)
        out = out.withColumn("_found", F.expr(f"transform(_found, r -> named_struct({fields}, '{name}', {sql}))"))
        have.append(name)
    return out


def _band(length: Column) -> Column:
    return sum((F.when(length >= b, 1).otherwise(0) for b in BANDS), F.lit(0))


def thresholds(candidates: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """Least bits of a discovery in each band of lengths, by Benjamini-Hochberg.

    ``candidates``: columns ``_token``, ``_bits`` and ``_random`` of all documents. What
    reaches the driver is a histogram of fixed size.
    """
    rows = candidates.groupBy(_band(F.length("_token")).alias("band"), F.when(F.col("_random"), F.col("_bits")).otherwise(-1).alias("bits")).count().collect()
    out = {}
    for band in {r.band for r in rows}:
        own = {r.bits: r["count"] for r in rows if r.band == band}
        tests, found = sum(own.values()), 0
        for bits in range(MAX_BITS, -1, -1):
            found += own.get(bits, 0)
            if found and tests * 2.0**-bits <= share * found:
                out[band] = bits
    return out


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with ``base`` and ``spans``: arrays of (start, rank of the kind, end, kind)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    text = docs.select(*(F.col(c).alias(f"k_{c}") for c in keep), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    least = thresholds(_tested(text.select("_text")).select(F.explode("_found").alias("r")).select("r._token", "r._bits", "r._random"))
    kept = [f"k_{c}" for c in keep]
    p = "r'" + ASSIGN.replace("'", r"\x27") + "'"
    value = F.expr(f"case when size(_assign) > 0 then zip_with(_assign, regexp_extract_all(_text, {p}, 2), (x, v) -> named_struct('start', x.start, 'end', x.end, 'token', v)) else _assign end")
    out = text.withColumn("_assign", _found(ASSIGN)).withColumn("_assign", value).withColumn("_assign", F.expr(f"filter(_assign, x -> length(x.token) >= {ASSIGN_VALUE})"))
    out = out.withColumns({"_access": _found(ACCESS), "_hex": _found(HEX)})
    span = lambda c, i: F.expr(f"transform({c}, x -> named_struct('start', x.start, 'rank', {i}, 'end', x.end, 'kind', '{KINDS[i]}'))")
    out = out.withColumn("base", F.array_sort(F.concat(span("_assign", 0), span("_access", 1), span("_hex", 2))))
    band = " + ".join(f"cast(length(r._token) >= {b} as int)" for b in BANDS)
    enough = " or ".join(f"({band} = {k} and r._bits >= {v})" for k, v in sorted(least.items())) or "false"
    out = _tested(out)
    out = out.withColumn("_found", F.expr(f"filter(_found, r -> r._random and ({enough}) and not exists(base, b -> b.start < r.end and r.start < b.end))"))
    out = out.withColumn("spans", F.array_sort(F.concat("base", span("_found", 3))))
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep)), "base", "spans")


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with every span, or group of overlapping spans, replaced. Without spans the text stays as it is."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(by))).alias("out"),
    )
    masked = F.aggregate(spans, start, cut, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) > 0, masked).otherwise(text)
