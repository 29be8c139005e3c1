"""Personal data: high-recall generators propose spans, boosted trees and calibrated thresholds select them.

Four kinds have an exact base form, which always counts. Further spans, such as numbers without a country code or
addresses spelt with "(at)", come from generators that find too much. Each candidate gets features of its format and of
the words around it; boosted trees trained on a small labelled table (labelled_texts) score it, and a threshold per
generator, calibrated on held-out rows of that table, decides. Everything is SQL expressions over one scan: no shuffle.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.trees import boosted_trees, margin

#: Kinds in order. The last has no base form.
KINDS = ("email", "ip", "card", "phone", "id_number")
#: The four base forms, written so that no text costs more than time in proportion to its length: a match starts only where
#: a run of its characters starts (or the match before ended), runs are possessive, and no group repeats without bound.
#: In an address, dots before anything but a label character have become \x01 (see dotted).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\-\x01]))[A-Za-z0-9._%+\-\x01]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators: kind, a cheap test of the text, and the pattern.
GENERATORS = (
    ("phone", r"[0-9]", r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{2,4}(?:[ .-][0-9]{2,5}){1,3}(?![0-9A-Za-z])"),
    ("phone", r"[0-9]{9}", r"(?<![0-9A-Za-z+.-])0[0-9]{8,11}(?![0-9A-Za-z])"),
    ("email", r"(?i)[(\[{] ?at ?[)\]}]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?[(\[{] ?at ?[)\]}] ?[a-z0-9-]{1,63}(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[a-z0-9-]{2,63}){1,4}"),
    ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("id_number", r"[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])"),
)
CUES = {
    "call_cue": r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|dial|ring|sms|whatsapp|telefon|anrufen|teléfono|appelez)\b",
    "mail_cue": r"(?i)\b(?:e-?mail|mail|write to|contact|reach|correo|courriel)\b",
    "person_cue": r"(?i)\b(?:ssn|social security|tax id|passport|id number|national id|insurance number)\b",
    "thing_cue": r"(?i)\b(?:isbn|order|invoice|version|part|serial|model|item|sku|ticket|page|lot|ref|no|between|from|score|build)\b|[#$€£]",
}
FEATURES = ["generator", "digits", "length", "groups", "paren", "dated", "same", *CUES, "sentence_end"]
AROUND = 32
#: Long arrays are added up block by block, and texts are cut into pieces, so that no element costs more the later it comes.
BLOCK = 256
SPAN = "array<struct<start:int,end:int,hit:string>>"


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once, however often it is used and in whatever loop."""
    return F.transform(F.array(value), then)[0]


def spans(text: Column, pattern: str) -> Column:
    """start, end (code points), hit of each match, leftmost first, none overlapping: lengths of gaps and matches, added up,
    first over blocks, then within them, since a fold that appends copies what it has."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.concat(F.regexp_extract_all(text, F.lit(pattern), 0), F.array(F.lit(""))), lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")))
    cut_up = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, BLOCK))
    size = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.char_length(x["hit"]))

    def within(state, x):
        start = state["at"] + x["gap"]
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(x["hit"] == "", state["found"]).otherwise(F.concat(state["found"], F.array(span))).alias("found"))

    def begin(state, block):
        return F.struct((state["at"] + size(block)).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    starts = lambda parts: F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), begin, lambda state: state["starts"])
    spans_of = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("found")), within, lambda state: state["found"])
    return bound(bound(pairs, cut_up), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), spans_of)))


def pieces_of(text: Column) -> Column:
    """The text in pieces of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def cut(pieces: Column, start: Column, size: Column) -> Column:
    """The BLOCK or fewer characters of a text in pieces from start on (less where the text ends)."""
    first = F.floor(start / BLOCK).cast("int")
    return F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit(""))).substr(start - first * BLOCK + 1, size)


def first_index(found: Column, beyond: Column, field: str) -> Column:
    """The index of the first of some spans in order whose field is above a bound (their number if there is none), by halving."""
    size = F.size(found)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1)

    def half(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = F.get(found, middle)[field] <= beyond
        done = state["low"] >= state["high"]
        low = F.when(done | ~below, state["low"]).otherwise(middle + 1)
        return F.struct(low.alias("low"), F.when(done | below, state["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), size.alias("high")), half, lambda state: state["low"])


def meeting(found: Column, c: Column) -> Column:
    """The spans that overlap span c, of spans in order of which none overlap each other."""
    return bound(first_index(found, c["start"], "end"), lambda first: F.slice(found, first + 1, first_index(found, c["end"] - 1, "start") - first))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Every second digit from the right counts double, less nine above nine; the sum must end in 0."""
    digits = F.reverse(F.split(digits_of(hit), ""))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def dotted(text: Column) -> Column:
    """The text with \\x01 for each dot that no label character follows; a \\x01 of the text's own becomes \\x02."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), r"\.(?![A-Za-z0-9-])", "\x01")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base form; cheap tests keep texts without a sign of a kind away from its pattern."""
    none = F.array().cast(SPAN)
    small = lambda s: F.forall(F.split(s["hit"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(p, -3, 3).cast("int") <= 255))
    return {
        "email": F.when(F.instr(text, "@") > 0, spans(dotted(text), BASE["email"])).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, BASE["ip"]), small)).otherwise(none),
        "card": F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), F.filter(spans(text, BASE["card"]), lambda s: luhn(s["hit"]))).otherwise(none),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(spans(text, BASE["phone"]), lambda s: F.length(digits_of(s["hit"])).between(9, 15))).otherwise(none),
    }


def candidates(text: Column) -> Column:
    """start, end, hit, generator of all generators' matches; they may overlap."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string,generator:int>>")
    numbered = lambda i: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.lit(i).alias("generator"))
    return F.concat(*[F.when(text.rlike(test), F.transform(spans(text, pattern), numbered(i))).otherwise(none) for i, (_, test, pattern) in enumerate(GENERATORS)])


def features_of(pieces: Column, c: Column) -> list[Column]:
    """FEATURES of a candidate, from its form and AROUND characters before and after it in a text in pieces."""
    before = cut(pieces, F.greatest(c["start"] - AROUND, F.lit(0)), F.least(c["start"], F.lit(AROUND)))
    after = cut(pieces, c["end"], F.lit(AROUND))
    digits = digits_of(c["hit"])
    number = lambda x: x.cast("double")
    return [
        number(c["generator"]), number(F.length(digits)), number(F.char_length(c["hit"])), number(F.size(F.split(c["hit"], "[ .-]+"))), number(F.instr(c["hit"], "(") > 0),
        number(c["hit"].rlike(r"^(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]|^[0-3]?[0-9][ .-][01]?[0-9][ .-](?:19|20)[0-9]{2}")),
        number(digits.rlike(r"^([0-9])\1+$")), *[number(F.concat_ws(" ", before, after).rlike(p)) for p in CUES.values()], number(after.rlike(r"^ ?[.,;)]?(?:\s|$)")),
    ]


@dataclass(frozen=True)
class Selector:
    trees: list[tuple[float, object]]
    thresholds: list[float]


def labelled_texts(count: int = 600, seed: int = 5) -> list[tuple[int, str, int]]:
    """The small labelled table: row, text, and whether the number or address in it is personal."""
    draw = random.Random(seed)
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    sep = lambda: draw.choice(" -.")
    word = lambda: draw.choice("ana ben cleo dora emil".split())
    personal = (
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: (s := sep()) and f"{d(3)}{s}{d(3)}{s}{d(4)}", lambda: "0" + d(draw.randint(9, 11)), lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"{word()}.{word()} [at] mail [dot] org", lambda: f"{word()} (at) {word()}.com", lambda: ":".join(f"{draw.randrange(65536):x}" for _ in range(8)),
        lambda: f"0{d(2)} {d(4)} {d(4)}",
    )
    things = (
        lambda: f"{draw.randint(1900, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}", lambda: f"{d(2)}.{d(2)}.{draw.randint(1900, 2030)}", lambda: f"{d(2)} {d(3)} {d(3)}",
        lambda: f"{d(3)}-{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: "0" + d(9), lambda: "000-000-0000", lambda: f"{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}",
    )
    cues = "call|phone|tel|email|mail|contact|my mobile is|reach me:|my ssn is|social security|ring".split("|")
    marks = "order no|invoice|isbn|part|version|serial|score|item|ticket|lot|page|between".split("|")
    rows = []
    for i in range(count):
        if i % 2:
            cue = draw.choice(cues) if draw.random() < 0.6 else "word"
            rows.append((i, f"some words here {cue} {draw.choice(personal)()}{draw.choice(('.', ' and more', ', thanks', ''))}", 1))
        else:
            mark = draw.choice(marks) if draw.random() < 0.8 else "word"
            rows.append((i, f"some words here {mark} {draw.choice(things)()}{draw.choice(('.', ' and more', '-x', ''))}", 0))
    return rows


def train(spark: SparkSession, rounds: int = 10, depth: int = 3, precision: float = 0.9) -> Selector:
    """Trees from two thirds of the labelled table; a generator's threshold is the least margin of 0 or more above which
    at least `precision` of the other third is personal."""
    table = spark.createDataFrame(labelled_texts(), "row int, text string, label int").select("row", "label", pieces_of(F.col("text")).alias("pieces"), F.explode(candidates(F.col("text"))).alias("c"))
    named = [x.alias(f) for x, f in zip(features_of(F.col("pieces"), F.col("c")), FEATURES)]
    rows = spark.createDataFrame(table.select("row", *named, "label").toPandas())  # a few hundred rows, read for each tree
    trees = boosted_trees(rows.where("row % 3 <> 0"), FEATURES, rounds, depth)
    held = rows.where("row % 3 = 0").select("generator", "label", margin(trees, [F.col(f) for f in FEATURES]).alias("margin")).toPandas()
    thresholds = []
    for i in range(len(GENERATORS)):
        own = held[(held["generator"] == i) & (held["margin"] >= 0)].sort_values("margin", ascending=False)
        right = own["label"].cumsum() / range(1, len(own) + 1)
        good = own["margin"][right >= precision]
        thresholds.append(float(good.min()) if len(good) else 0.0)
    return Selector(trees, thresholds)


def personal_data(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """doc_id, text, base (spans by kind), added (spans the trees select, each with kind and margin) for each row of docs.

    A null text counts as empty. Added spans that overlap a base span are dropped; of added spans that overlap each
    other the one with the highest margin stays, the first of equals. Other columns of docs are ignored. Time grows with
    the length of a text and the number of its spans, and little more.
    """
    selector = train(docs.sparkSession) if selector is None else selector
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", *[v.alias(k) for k, v in base_spans(F.col("text")).items()], candidates(F.col("text")).alias("proposed"))
    rows = rows.withColumn("pieces", F.when(F.size("proposed") > 0, pieces_of(F.col("text"))))
    kinds, least = F.array(*[F.lit(k) for k, _, _ in GENERATORS]), F.array(*map(F.lit, selector.thresholds))
    score = lambda c: bound(F.array(*features_of(F.col("pieces"), c)), lambda f: margin(selector.trees, [f[i] for i in range(len(FEATURES))]))
    scored = F.transform("proposed", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), kinds[c["generator"]].alias("kind"), score(c).alias("margin"), least[c["generator"]].alias("least"), c["generator"].alias("generator")))
    kind_of = "start:int,end:int,kind:string,margin:double,least:double"
    rows = rows.withColumn("scored", F.when(F.size("proposed") == 0, F.array().cast(f"array<struct<{kind_of},generator:int>>")).otherwise(scored))
    # spans of one base form, or of one generator, are in order and do not overlap
    free = lambda c: F.forall(F.array(*[F.size(meeting(F.col(k), c)) for k in BASE]), lambda n: n == 0)
    rows = rows.withColumn("good", F.filter("scored", lambda c: (c["margin"] >= c["least"]) & free(c)))
    order = lambda c: F.struct(-c["margin"], c["start"], -c["end"], c["kind"], c["generator"])
    own = [F.col(f"own{i}") for i in range(len(GENERATORS))]
    rows = rows.withColumns({f"own{i}": F.filter("good", lambda c: c["generator"] == i) for i in range(len(GENERATORS))})  # noqa: B023
    best = lambda c: ~F.exists(F.concat(*[meeting(spans, c) for spans in own]), lambda o: order(o) < order(c))
    return rows.select("doc_id", "text", *BASE, F.filter("good", best).cast(f"array<struct<{kind_of},generator:int>>").alias("added"))


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans, base_sha256, spans, n_added of personal_data's rows."""
    line = lambda kind: lambda s: F.concat_ws(":", kind if isinstance(kind, Column) else F.lit(kind), s["start"], s["end"])
    base = F.concat(*[F.transform(k, line(k)) for k in BASE])
    of_kind = lambda kind: lambda s: s["kind"] == kind
    both = []
    for kind in KINDS:
        more = F.filter("added", of_kind(kind))
        own = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) if kind in BASE else F.array().cast("array<struct<start:int,end:int>>")
        merged = F.array_sort(F.concat(own, F.transform(more, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
        both.append(F.transform(merged, line(kind)))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*both), ",").alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """doc_id, text with each found span replaced by its kind in brackets; of overlapping ones the first, longest is replaced."""
    found = personal_data(docs, selector)
    plain = lambda kind: lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"))
    every = F.array_sort(F.concat(*[F.transform(k, plain(k)) for k in BASE], F.transform("added", lambda s: plain(s["kind"])(s))))
    text = F.col("text")

    def add(state, s):
        gap = text.substr(state["at"] + 1, s["start"] - state["at"])
        return F.when(s["start"] < state["at"], state).otherwise(F.struct((-s["end"]).alias("at"), F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out")))

    return found.select("doc_id", F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.char_length(text)))).alias("text"))
