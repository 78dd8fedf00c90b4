"""Personal data by base patterns and bootstrapped contexts, in DataFrame functions only.

Base matches (e-mail addresses, IP addresses, card and phone numbers) are found by one
regular expression per kind and are the seeds. The two words before a seed are its
lexical pattern. Other identifier-like tokens and groups of digits stand behind patterns
too, so patterns and instances form a graph. Scores run over it in rounds: a pattern is trusted as far as
its instances are known to be of one kind, and an instance as far as its patterns are
trusted. Tokens behind a pattern of high confidence are added as spans of its kind;
base spans always stay.

The expressions are possessive and anchored at the start of a run of their characters, so
that they run in linear time and constant stack on any text, and match the same places
as the plain ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.llm.common import table
from gleanery.session import written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A character that every match has; texts without it are not searched.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
# Identifier-like tokens: no white space or enclosing signs, a digit or an @.
_TOKEN = r"[^\s,;:()<>\[\]{}\"'|]"
TOKEN = rf"(?<!{_TOKEN})(?:(?![0-9@]){_TOKEN})*+[0-9@]{_TOKEN}*+"
# Groups of digits, each plain or in brackets, joined over single spaces, hyphens and dots.
# A plain group ends where its token ends, up to the stops of a sentence.
_GROUP = rf"(?:\([0-9]++\)|[0-9]++(?:[.-][0-9]++)*+(?=[.!?]*+(?!{_TOKEN})|[.-]\([0-9]))"
GROUPS = rf"(?:(?<!{_TOKEN})\+?+(?=[0-9(])|(?=\()){_GROUP}(?:[ .-]?+{_GROUP})*+"
CANDIDATE = f"{GROUPS}|{TOKEN}"
# Characters before an identifier in which its pattern's words are looked for.
CONTEXT = 64
ROUNDS = 3
LEAST_SEEDS = 3
CONFIDENCE = 0.6
# _GONE stands for the digits of base spans where they are not to be joined to others.
_OPEN, _SHUT, _GONE = "\u0001", "\u0002", "\u0004"

SPAN = "struct<start:int,end:int,value:string,before:string>"


def _gap(piece: Column) -> Column:
    """What follows the match at the head of a piece."""
    return F.substr(piece, F.instr(piece, _SHUT) + 1, F.length(piece))


def _named(value: Column, use) -> Column:
    """use(value), with the value computed once: the element of a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marked(text: Column, pattern: str, keep) -> Column:
    """Spans of the matches that `keep` says, with the text before each, by one pass.

    Matches are set between two control characters (which the text has not, see
    `_clean`), and the pieces between them are counted through. This is done in about
    sqrt(n) runs of sqrt(n) pieces, because a list that grows is copied at every step.
    """

    def count(done: Column, piece: Column) -> Column:
        cut = F.instr(piece, _SHUT)
        value = F.left(piece, cut - 1)
        end = done["at"] + F.greatest(cut - 1, F.lit(0))
        span = F.struct(
            done["at"].alias("start"), end.alias("end"), value.alias("value"), done["gap"].alias("before")
        )
        gap = _gap(piece)
        return F.struct(
            (end + F.length(gap)).alias("at"),
            F.right(gap, F.lit(CONTEXT)).alias("gap"),
            F.when((cut > 0) & keep(value), F.concat(done["spans"], F.array(span)))
            .otherwise(done["spans"])
            .alias("spans"),
        )

    def spans(pieces: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(pieces))), F.lit(64)).cast("int")
        runs = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / width).cast("int"))

        def run(c: Column) -> Column:
            return F.slice(pieces, c * width + 1, width)

        def size(total: Column, piece: Column) -> Column:
            return total + F.length(piece) - (F.instr(piece, _SHUT) > 0).cast("int")

        def found(sizes: Column) -> Column:
            def one(c: Column) -> Column:
                at = F.aggregate(F.slice(sizes, F.lit(1), c), F.lit(0), lambda total, n: total + n)
                gap = F.when(c > 0, F.right(_gap(F.get(pieces, c * width - 1)), F.lit(CONTEXT))).otherwise("")
                none = F.array().cast(f"array<{SPAN}>")
                start = F.struct(at.alias("at"), gap.alias("gap"), none.alias("spans"))
                return F.aggregate(run(c), start, count, lambda done: done["spans"])

            return F.flatten(F.transform(runs, one))

        return _named(F.transform(runs, lambda c: F.aggregate(run(c), F.lit(0), size)), found)

    return _named(F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN, -1), spans)


def _clean(text: Column) -> Column:
    """Null is empty; the marking characters become another control character."""
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _SHUT + _GONE, "\u0003" * 3)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    n = F.length(_digits(value))
    return n.between(9, 15) if kind == "phone" else n.between(13, 19) & _luhn(value)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of a kind, leftmost and not overlapping, in order."""
    none = F.array().cast(f"array<{SPAN}>")
    found = _marked(text, PATTERNS[kind], lambda value: _valid(kind, value))
    needed = F.contains(text, F.lit(NEEDED[kind])) if kind in NEEDED else F.lit(True)
    return F.when(needed & text.rlike("[0-9@]"), found).otherwise(none)


def _masked(text: Column, kind: str) -> Column:
    """The text with _GONE for the digits of the valid matches of a kind."""

    def mask(piece: Column) -> Column:
        value = F.left(piece, F.instr(piece, _SHUT) - 1)
        gone = F.when(_valid(kind, value), F.translate(value, "0123456789", _GONE * 10)).otherwise(value)
        return F.when(F.instr(piece, _SHUT) > 0, F.concat(gone, _gap(piece))).otherwise(piece)

    pieces = F.split(F.regexp_replace(text, PATTERNS[kind], f"{_OPEN}$0{_SHUT}"), _OPEN, -1)
    return F.array_join(F.transform(pieces, mask), "")


def _candidates(text: Column, base: Column) -> Column:
    """Groups of digits and other identifier-like tokens of five characters or more, with
    an @ or four digits or more, that no base span touches.

    Groups are joined as far as they go, but not to the digits of addresses and cards among
    the base spans (those of phone numbers have no groups beside them). The stops that
    end a sentence are not part of a candidate.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def like(value: Column) -> Column:
        return (F.length(value) >= 5) & (F.contains(value, F.lit("@")) | (F.length(_digits(value)) >= 4))

    def trimmed(token: Column) -> Column:
        value = F.rtrim(token["value"], F.lit(".!?"))
        end = token["start"] + F.length(value)
        before = F.translate(token["before"], _GONE, "0")  # a pattern has 0 for every digit
        return F.struct(token["start"].alias("start"), end.alias("end"), value.alias("value"), before.alias("before"))

    def new(token: Column) -> Column:
        touched = F.exists(base, lambda s: (s["start"] < token["end"]) & (token["start"] < s["end"]))
        return like(token["value"]) & ~touched

    apart = F.when(F.size(base) > 0, _masked(_masked(text, "card"), "ip")).otherwise(text)
    tokens = F.transform(_marked(apart, CANDIDATE, like), trimmed)
    return F.when(text.rlike("[0-9@]"), F.filter(tokens, new)).otherwise(none)


def _pattern(before: Column) -> Column:
    """The last two words, in lower case and with digits as 0; null if they have no letter."""
    last = F.regexp_extract(F.lower(before), r"(\S+\s+\S+|\S+)\s*$", 1)
    plain = F.regexp_replace(F.regexp_replace(last, "[0-9]", "0"), r"\s+", " ")
    return F.when(plain.rlike(r"\p{L}"), plain)


def learn_patterns(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Patterns of high confidence: pattern, kind (its number), confidence.

    `graph` has one row per pattern and instance, with the kind number of the instance or
    null if it is unknown. Every round is two aggregates over the graph, which combine
    before the shuffle, and two joins; it is written, so a lost executor costs one round.
    A pattern needs LEAST_SEEDS different seeds of its kind. Seeds are the base instances
    and, in later rounds, instances whose score has reached CONFIDENCE, so that patterns
    with discovered instances alone are learned too.
    """
    seeds = [F.max((F.col("kind") == k).cast("double")).alias(f"c{k}") for k in range(len(KINDS))]
    edges = graph.groupBy("pattern", "instance").agg(*seeds).na.fill(0.0)
    known = edges = written(edges, "pattern-graph")
    patterns = None
    for number in range(rounds):
        score = [(F.sum(f"c{k}") / (F.count("*") + 1)).alias(f"s{k}") for k in range(len(KINDS))]
        support = [F.sum((F.col(f"c{k}") >= CONFIDENCE).cast("long")).alias(f"n{k}") for k in range(len(KINDS))]
        patterns = written(known.groupBy("pattern").agg(*score, *support), "patterns")
        if number == rounds - 1:
            break
        trust = [F.when(F.col(f"n{k}") >= LEAST_SEEDS, F.col(f"s{k}")).otherwise(0.0) for k in range(len(KINDS))]
        trusted = patterns.select("pattern", *(t.alias(f"t{k}") for k, t in enumerate(trust)))
        reached = edges.select("pattern", "instance", *(f"c{k}" for k in range(len(KINDS)))).join(trusted, "pattern")
        # Known instances stay certain; an unknown one is as sure as its best pattern.
        sure = [F.max(F.greatest(f"c{k}", f"t{k}")).alias(f"c{k}") for k in range(len(KINDS))]
        instances = reached.groupBy("instance").agg(*sure)
        known = written(edges.select("pattern", "instance").join(instances, "instance"), "instances")
    best = F.greatest(
        *(
            F.struct(
                F.when(F.col(f"n{k}") >= LEAST_SEEDS, F.col(f"s{k}")).otherwise(0.0).alias("confidence"),
                F.lit(k).alias("kind"),
            )
            for k in range(len(KINDS))
        )
    )
    return patterns.select("pattern", best.alias("best")).select("pattern", "best.*").where(
        F.col("confidence") >= CONFIDENCE
    )


def _of_kind(number: int):
    return lambda span: F.struct(F.lit(number).alias("kind"), span.alias("span"))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every document: doc_id, base and added (arrays of kind number, start, end).

    Offsets are code points of the whole text, end exclusive; null and empty texts have no
    spans. `base` is in order of kind, then start. `added` are tokens behind patterns of
    high confidence, never touching a base span of their document. Repeated rows get the
    same spans; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), _clean(F.col(text)).alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(kind, base_spans(F.col("text"), kind))
    base = F.flatten(F.array(*(F.transform(kind, _of_kind(k)) for k, kind in enumerate(KINDS))))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text"), F.length("text"))
    found = rows.select("doc_id", key.alias("key"), base.alias("base"), "text")
    tokens = _candidates(F.col("text"), F.transform("base", lambda b: b["span"]))
    found = written(found.select("doc_id", "key", "base", tokens.alias("tokens")), "spans")

    seeds = found.select(F.explode("base").alias("b")).select(F.col("b.kind").alias("kind"), "b.span.*")
    others = found.select("key", F.explode("tokens").alias("t")).select("key", F.lit(None).cast("int").alias("kind"), "t.*")
    both = seeds.unionByName(others.drop("key"))
    graph = both.select(
        _pattern(F.col("before")).alias("pattern"), F.xxhash64(F.lower("value")).alias("instance"), "kind"
    )
    patterns = learn_patterns(graph.where("pattern is not null"))
    behind = others.select("key", "start", "end", _pattern(F.col("before")).alias("pattern"))
    new = behind.join(patterns.select("pattern", "kind"), "pattern")
    new = new.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["span"]["start"].alias("start"), b["span"]["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.select("doc_id", "key", plain.alias("base")).join(new, "key", "left").select(
        "doc_id", "base", F.coalesce(F.array_sort("added"), none).alias("added")
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    return F.array_join(one, ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)
    ]
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
