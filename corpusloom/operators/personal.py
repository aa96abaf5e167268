"""Personal data: candidates by pattern, checked by their digits, resolved where they overlap, and replaced by marks.

Each kind has a pattern that RE2 and Java read alike once ``text.ascii_borders`` has spelt out its word borders, and a check on what it finds: card numbers by Luhn's sum, account numbers
(IBAN) by their remainder of 97, network addresses by their four numbers, telephone numbers by how many digits they have and
how these are set apart. Of findings that overlap, the kind that stands first in ``KINDS`` stays; of one kind the first,
which is how the pattern was read. All of it is column expressions on one row: nothing is shuffled and no Python runs.

Places come from the text between the findings: pieces and findings alternate, so their lengths add up to where each stands.

Edge cases: a null text has null spans and stays null; an empty one has none; texts of any length are read whole; marks
that stand in a text already are no findings; repeated rows give the same again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ascii_borders

#: Kinds from the surest to the least sure, their patterns, and their marks.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+?\(?[0-9][0-9 ().-]{7,}[0-9]",
}
MARKS = {"email": "[EMAIL]", "iban": "[IBAN]", "card": "[CARD]", "ip": "[IP]", "phone": "[PHONE]"}
PHONE_DIGITS = (9, 15)


def _digits(found: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(found, "[^0-9]", ""), ""), lambda d: d != "")


def luhn(found: Column) -> Column:
    """Whether the digits, every second one from the right doubled, add up to a multiple of ten."""
    back = F.reverse(_digits(found))
    twice = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    worth = F.transform(back, lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(found: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 of 97."""
    plain = F.regexp_replace(found, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return (F.length(plain).between(15, 34)) & (F.aggregate(chars, F.lit(0), lambda a, c: step(a, c)) == 1)


def four_numbers(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda n: n.cast("int") <= 255)


def telephone(found: Column) -> Column:
    """Set apart or with a plus, of a fitting number of digits; a run of digits alone is a number like any other."""
    n = F.size(_digits(found))
    return n.between(*PHONE_DIGITS) & (found.startswith("+") | found.rlike(r"[0-9)][ .()-]+[0-9(]")) & ~found.rlike(r"^[0-9]+\.[0-9]+$|[.-]{2}| {2}")


CHECKS = {"iban": mod97, "card": luhn, "ip": four_numbers, "phone": telephone}


def candidates(text: Column, kind: str) -> Column:
    """Structs (start, end, kind, found) of a kind's findings, in code points from 0; ``text`` is not null."""
    pattern = ascii_borders(KINDS[kind])
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("found"), F.slice(pieces, 1, F.greatest(F.size(found), F.lit(1))).alias("piece"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,found:string>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = (start + F.length(x["found"])).cast("int")
        span = F.struct(start.cast("int").alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    spans = F.when(F.size(found) > 0, F.aggregate(both, first, step)["spans"]).otherwise(empty)
    return F.filter(spans, lambda s: CHECKS[kind](s["found"])) if kind in CHECKS else spans


SPANS = "array<struct<start:int,end:int,kind:string,found:string>>"
RANKED = "array<struct<rank:int,start:int,end:int,kind:string,found:string>>"


def _surest(cluster: Column) -> Column:
    """Of spans (``RANKED``) that overlap in a chain, those that no surer one overlaps, as ``SPANS``."""
    clear = lambda kept, s: ~F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found"))
    add = lambda a, s: F.when(clear(a, s), F.concat(a, F.array(plain(s)))).otherwise(a)
    return F.array_sort(F.aggregate(F.array_sort(cluster), F.array().cast(SPANS), add))


def personal_spans(text: Column, kinds: Sequence[str] = tuple(KINDS)) -> Column:
    """The findings of ``kinds``, in order, none of which overlaps another; other kinds displace nothing.

    A sweep by start gathers spans that overlap in a chain, and each such cluster is resolved when the next one begins.
    """

    def by_start(rank: int):
        # Of one parameter: Spark hands an element's place in its array to a second one.
        return lambda s: F.struct(s["start"].alias("start"), F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found")).alias("span"))

    all_ = F.array_sort(F.concat(*[F.transform(candidates(text, kind), by_start(i)) for i, kind in enumerate(KINDS) if kind in kinds]))
    first = F.struct(F.array().cast(SPANS).alias("done"), F.array().cast(RANKED).alias("cluster"), F.lit(0).alias("end"))

    def step(state: Column, x: Column) -> Column:
        s = x["span"]
        more = F.struct(state["done"].alias("done"), F.concat(state["cluster"], F.array(s)).alias("cluster"), F.greatest(state["end"], s["end"]).alias("end"))
        next_ = F.struct(F.concat(state["done"], _surest(state["cluster"])).alias("done"), F.array(s).alias("cluster"), s["end"].alias("end"))
        return F.when(s["start"] < state["end"], more).otherwise(next_)

    found = F.aggregate(all_, first, step, lambda state: F.concat(state["done"], _surest(state["cluster"])))
    return F.when(text.isNotNull(), found)


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with a mark for each finding."""
    mark = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.element_at(mark, s["kind"])).alias("out"))
    last = F.aggregate(spans, first, step)
    return F.concat(last["out"], text.substr(last["at"] + 1, F.length(text)))
