"""Personal data in texts: fixed forms, and what stands where such data usually stands, by bootstrapped extraction.

Emails, IP addresses, card and phone numbers of fixed form are found by regular expressions (base spans). They are the seeds
of a search for the same kinds of data in other forms: a card number with a wrong digit, a phone number without a country, an
address spelt with "(at)". Candidates are tokens of a looser form for each kind. Lexical patterns are the one and the two
words before a candidate. Patterns and the values they stand before make a graph, whose edges count occurrences:

1. A pattern's confidence for a kind is the share of all its occurrences in the texts that stand before a value of that kind which
   is known. It needs `support` different known values: copies of a text are no further evidence.
2. A value's confidence is that of at least one of its patterns being right, 1 - product of (1 - confidence). Values at or above
   `certain` are known from then on, and both steps are taken again, `rounds` times in all.

Spans of values that are known in the end, where they stand behind an accepted pattern, are added to the base spans.

All of it is DataFrame expressions, without Python workers. Graph tables are counted per task before they are shuffled and are
stored in the shared folder; patterns and values meet by joins, which split hot keys. Regular expressions start only at
the borders of their characters and give nothing back once matched, so a long run of letters or digits is passed once. Positions are running sums
of the lengths of matches and what lies between them, in blocks, so that many matches in one text stay cheap.

Defined cases: a null text is empty and has no spans. Empty texts have none. Very long texts are searched whole; a row's words are in
memory while they are counted. Repeated rows have a row each, and count as occurrences, not as values. Of two candidates of one start
the one with the higher confidence stays, then the kind that comes first; candidates that overlap a base span are left out.
Null and repeated ids need nothing special: rows are told apart by a number of their own. An empty table gives no rows.
Further columns, whatever their names, are not looked at. Without any seed nothing is added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import taken
from hearthline.runtime import durable

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
# Fixed forms. A possessive quantifier changes no match here, as what follows it can't be among its characters.
FORMS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"[ ]?[\[(](?:at|AT)[\])][ ]?", r"[ ]?[\[(](?:dot|DOT)[\])][ ]?"
# Looser forms, of whole tokens.
LOOSE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++(?:@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]++(?:\.[0-9]++){3,}+|(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){11,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+(-])(?:\+|\+?\()?[0-9][ ().0-9/-]{4,30}[0-9](?![0-9A-Za-z])",
}
DIGITS = {"card": (13, 19), "phone": (9, 15)}
LOOSE_DIGITS = {"card": (12, 19), "phone": (7, 15)}
# Between words: white space, or the place behind a sign that words are introduced with.
BETWEEN = r"(?<=[:=#\x22\x27(\[<])\s*|\s+"
# Characters before a candidate in which its words are looked for.
NEARBY = 64
# Lengths that are added up in one go.
BLOCK = 128
SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Trust:
    """How much evidence patterns and values need."""

    support: int = 4
    confidence: float = 0.5
    certain: float = 0.8
    rounds: int = 3


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(number: str) -> str:
    """Whether a number passes: its last digit counts once, the one before twice with digits added up, and so on."""
    digit = f"substring(reverse({number}), place, 1)"
    each = f"if(place % 2 = 1, {digit}, translate({digit}, '0123456789', '0246813579'))"
    return f"aggregate(sequence(1, length({number})), 0, (total, place) -> total + CAST({each} AS INT)) % 10 = 0"


def valid(kind: str, value: str) -> str:
    """Whether a match of a fixed form counts."""
    if kind == "email":
        return "true"
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return rf"{value} rlike r'^{part}(?:\.{part}){{3}}$'"
    low, high = DIGITS[kind]
    inside = f"length({digits(value)}) BETWEEN {low} AND {high}"
    return f"if({inside}, {luhn(digits(value))}, false)" if kind == "card" else inside


def known(kind: str, value: str) -> str:
    """Whether a candidate has the fixed form and counts."""
    return f"if({value} rlike r'^(?:{FORMS[kind]})$', {valid(kind, value)}, false)"


def running(lengths: str) -> str:
    """The sums of the lengths up to each of them; block by block, as an array grows by copying."""
    start = "named_struct('a', CAST(array() AS ARRAY<BIGINT>), 's', 0L)"
    inside = f"aggregate(slice({lengths}, b * {BLOCK} + 1, {BLOCK}), {start}, (t, x) -> named_struct('a', concat(t.a, array(t.s + x)), 's', t.s + x)).a"
    runs = f"transform(sequence(0, CAST((size({lengths}) - 1) DIV {BLOCK} AS INT)), b -> {inside})"
    before = f"aggregate({runs}, {start}, (t, r) -> named_struct('a', concat(t.a, array(t.s)), 's', t.s + element_at(r, -1))).a"
    added = f"flatten(zip_with({runs}, {before}, (r, o) -> transform(r, x -> x + o)))"
    return f"if(size({lengths}) > 0, {added}, CAST(array() AS ARRAY<BIGINT>))"


# Where texts of each form may be at all.
MAY = {
    "email": "contains(text, '@')",
    "ip": "text rlike '[0-9]'",
    "card": "text rlike '[0-9]'",
    "phone": "contains(text, '+')",
    "loose_email": r"text rlike r'@|[\[(](?:at|AT)[\])]'",
    "loose_ip": "text rlike '[0-9]'",
    "loose_card": "text rlike '[0-9]'",
    "loose_phone": "text rlike '[0-9]'",
}


def _matches(df: DataFrame, forms: dict[str, str]) -> DataFrame:
    """Adds, for each form, all matches (m), the texts between them (g) and where each match ends, in code points (e)."""
    none = "CAST(array() AS ARRAY<STRING>)"
    found = [f"if({MAY[n]}, regexp_extract_all(text, r'{form}', 0), {none}) AS {n}_m" for n, form in forms.items()]
    gaps = [f"if(size({n}_m) > 0, split(text, r'{form}', -1), {none}) AS {n}_g" for n, form in forms.items()]
    sizes = [f"zip_with({n}_m, slice({n}_g, 1, size({n}_m)), (a, b) -> CAST(length(a) + length(b) AS BIGINT)) AS {n}_l" for n in forms]
    ends = [f"{running(f'{n}_l')} AS {n}_e" for n in forms]
    for step in (found, gaps, sizes, ends):
        df = df.selectExpr("*", *step)
    return df


def _base(kind: str) -> str:
    """The valid matches as spans."""
    span = f"named_struct('kind', {KINDS.index(kind)}, 'start', e - length(x), 'end', e)"
    spans = f"zip_with({kind}_m, {kind}_e, (x, e) -> if({valid(kind, 'x')}, {span}, null))"
    return f"filter({spans}, s -> s IS NOT NULL)"


def plain(text: str) -> str:
    """What contexts are made of: lower case, and one zero for any number."""
    return f"regexp_replace(lower({text}), '[0-9]+', '0')"


def _candidates(kind: str) -> str:
    """Loose matches: kind, start, end, value, known, and the words before them; null where there is none."""
    m, g, e = (f"element_at(loose_{kind}_{c}, i)" for c in "mge")
    value = digits(m) if kind in LOOSE_DIGITS else f"lower({m})"
    # The candidate before stands for itself as any number does.
    left = plain(f"substring(concat(if(i > 1, '0', ''), {g}), -{NEARBY}, {NEARBY})")
    # Only behind a border; then the last word is empty.
    contexts = (
        "transform(array(w), w -> array("
        "if(element_at(w, -1) = '' AND try_element_at(w, -2) <> '', try_element_at(w, -2), null), "
        "if(element_at(w, -1) = '' AND try_element_at(w, -2) <> '' AND try_element_at(w, -3) <> '', "
        "concat_ws(' ', try_element_at(w, -3), try_element_at(w, -2)), null)))[0]"
    ).replace("array(w)", f"array(split({left}, r'{BETWEEN}', -1))")
    one = (
        f"named_struct('kind', {KINDS.index(kind)}, 'start', {e} - length({m}), 'end', {e}, "
        f"'value', {value}, 'known', {known(kind, m)}, 'contexts', {contexts})"
    )
    low, high = LOOSE_DIGITS.get(kind, (1, 1 << 30))
    all_of = f"transform(sequence(1, size(loose_{kind}_m)), i -> if(length({value}) BETWEEN {low} AND {high}, {one}, null))"
    return f"if(size(loose_{kind}_m) > 0, filter({all_of}, c -> c IS NOT NULL), array())"


def _scanned(documents: DataFrame) -> DataFrame:
    """row, doc_id, base (spans of the fixed forms) and candidates, without the texts."""
    df = documents.selectExpr("row", "doc_id", "coalesce(text, '') AS text")
    df = _matches(df, FORMS | {f"loose_{kind}": form for kind, form in LOOSE.items()})
    base = f"concat({', '.join(map(_base, KINDS))}) AS base"
    return df.selectExpr("row", "doc_id", base, f"concat({', '.join(map(_candidates, KINDS))}) AS candidates")


def _occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(context, total): how often the words of each pattern stand anywhere in the texts."""
    words = f"filter(split({plain('text')}, r'{BETWEEN}', -1), w -> w <> '') AS w"
    pairs = "zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, size(w)), (a, b) -> concat_ws(' ', a, b))"
    spoken = texts.where("text <> ''").selectExpr(words).selectExpr(f"explode(concat(w, {pairs})) AS context")
    return spoken.join(patterns, "context", "left_semi").groupBy("context").agg(F.count(F.lit(1)).alias("total"))


def _settled(x: Column) -> Column:
    """Sums of doubles depend on their order in the last digits; decisions don't."""
    return F.round(x, 9)


def _confident(edges: DataFrame, totals: DataFrame, values: DataFrame, trust: Trust) -> DataFrame:
    """(kind, context, confidence) of the patterns that are accepted, given the known values."""
    seen = edges.join(values, ["kind", "value"], "left_semi").groupBy("kind", "context")
    counted = seen.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")).where(F.col("different") >= trust.support)
    share = _settled(F.col("n") / F.greatest("total", "n"))
    rated = counted.join(totals, "context").select("kind", "context", share.alias("confidence"))
    return rated.where(F.col("confidence") >= trust.confidence)


def _discovered(edges: DataFrame, patterns: DataFrame, trust: Trust) -> DataFrame:
    """(kind, value, confidence) of values that the patterns make certain."""
    doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
    rated = edges.join(patterns, ["kind", "context"]).groupBy("kind", "value").agg(_settled(1 - F.exp(doubt)).alias("confidence"))
    return rated.where(F.col("confidence") >= trust.certain)


def bootstrapped(edges: DataFrame, totals: DataFrame, trust: Trust) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns and discovered values, from edges (kind, context, value, n, known), stored, and the contexts' totals."""
    seeds = durable(edges.where("known").select("kind", "value").distinct())
    values = seeds
    for _ in range(trust.rounds):
        patterns = durable(_confident(edges, totals, values, trust))
        found = durable(_discovered(edges, patterns, trust))
        values = seeds.union(found.select("kind", "value")).distinct()
    return patterns, found


def personal_data(documents: DataFrame, trust: Trust = Trust(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (kind, start, end) in order of kind, a place in KINDS,
    and start; start and end count code points, end exclusive. spans has the base spans and those that were discovered."""
    docs = taken(documents, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id())
    rows = durable(_scanned(docs))
    each = rows.select("row", "base", F.explode("candidates").alias("c")).select("row", "base", "c.*")
    edges = each.select("kind", "value", "known", F.explode("contexts").alias("context")).where("context IS NOT NULL")
    edges = edges.groupBy("kind", "context", "value").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"))
    edges = durable(edges)
    # Only contexts that stand before enough different values can ever be accepted.
    enough = edges.groupBy("kind", "context").agg(F.count(F.lit(1)).alias("different")).where(F.col("different") >= trust.support)
    enough = durable(enough.select("context").distinct())
    edges = durable(edges.join(enough, "context", "left_semi"))
    totals = durable(_occurrences(docs.select("text"), enough))
    patterns, found = bootstrapped(edges, totals, trust)
    return _with_found(rows, each, patterns, found)


def _with_found(rows: DataFrame, each: DataFrame, patterns: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with the spans of discovered values that stand behind an accepted pattern."""
    free = F.forall("base", lambda b: (b["end"] <= F.col("start")) | (b["start"] >= F.col("end")))
    open_ = each.where(~F.col("known") & free).select("row", "kind", "start", "end", "value", F.explode("contexts").alias("context"))
    behind = open_.join(patterns.select("kind", "context"), ["kind", "context"], "left_semi").join(found, ["kind", "value"])
    # One span for a start: the most certain kind.
    best = F.max_by(F.struct("kind", "end"), F.struct("confidence", -F.col("kind"), "end")).alias("best")
    new = behind.groupBy("row", "start").agg(best).groupBy("row").agg(
        F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", F.col("best.end").alias("end"))).alias("new")
    )
    spans = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(SPAN))))
    return rows.join(new, "row", "left").select("doc_id", "base", spans.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    name = lambda kind: F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")
