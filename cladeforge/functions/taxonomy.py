"""Lineages in record labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks domain to genus; species and strain are read and left out.
RANKS = "dkpcofg"
LEVELS = len(RANKS)


def parse(label: Column) -> Column:
    """struct<lineage array<string>(7), error string> of a label with one ``;tax=``.

    Parts ``x:name`` stand in the order of ``dkpcofgst``, each at most once; a blank name is a
    missing rank (''); at least one of the seven is named; control characters are refused.
    """
    order = RANKS + "st"
    pieces = F.split(label, ";tax=", -1)
    field = F.split(F.try_element_at(pieces, F.lit(2)), ";", -1)[0]
    parts = F.coalesce(F.filter(F.split(field, ",", -1), lambda p: p != ""), F.array().cast("array<string>"))
    places = F.transform(parts, lambda p: F.when(F.substring(p, 2, 1) == ":", F.position(F.substring(p, 1, 1), F.lit(order))).otherwise(0))
    rising = F.aggregate(places, F.lit(0), lambda last, i: F.when((last >= 0) & (i > last), i).otherwise(-1)) >= 0
    rest = lambda p: F.substring(p, 3, 1 << 30)
    name = lambda p: F.when(rest(p).rlike(r"^\s*$"), "").otherwise(rest(p))

    def named(r: str) -> Column:
        own = F.filter(parts, lambda p: F.startswith(p, F.lit(f"{r}:")))
        return F.coalesce(F.try_element_at(F.transform(own, lambda p: name(p)), F.lit(1)), F.lit(""))

    lineage = F.array(*map(named, RANKS))
    error = (
        F.when(label.isNull() | (F.size(pieces) != 2), "needs exactly one tax field")
        .when(F.exists(places, lambda i: i == 0), "unknown rank")
        .when(~rising, "ranks out of order")
        .when(F.exists(parts, lambda p: rest(p).rlike("\\p{Cntrl}")), "control character")
        .when(F.forall(lineage, lambda n: n == ""), "no named rank")
    )
    return F.struct(lineage.alias("lineage"), error.alias("error"))
