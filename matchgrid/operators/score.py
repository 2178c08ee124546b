"""Scoreboard readings: parsing, validity, cleaning, point winners, stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a point reading may be.
POINTS = ("0", "15", "30", "40", "A", "AD", "AV")


def parse_rows(readings: DataFrame) -> DataFrame:
    """``rows`` (team, serving, values) to ``teams, serving, games, points``; null if unreadable.

    Two rows are needed, each with a value; blanks go; the last value is the
    points, the others are whole numbers; both teams have as many sets.
    """
    clean = F.transform("rows", lambda r: F.filter(F.transform(r["values"], lambda v: F.upper(F.trim(v))), lambda v: v != ""))
    r = readings.withColumn("vals", clean)
    games = F.transform("vals", lambda v: F.transform(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda x: x.try_cast("int")))
    r = r.withColumn("g", games)
    ok = F.expr(
        "size(rows) = 2 and forall(vals, v -> size(v) > 0) and forall(g, v -> forall(v, x -> x is not null))"
        " and size(g[0]) = size(g[1])"
    )
    state = F.struct(
        F.transform("rows", lambda x: F.upper(F.trim(x["team"]))).alias("teams"),
        F.transform("rows", lambda x: F.coalesce(x["serving"], F.lit(False))).alias("serving"),
        F.col("g").alias("games"),
        F.transform("vals", lambda v: F.element_at(v, -1)).alias("points"),
    )
    return r.withColumn("state", F.when(ok, state)).drop("vals", "g")


def tiebreak(games: str = "games") -> Column:
    return F.expr(f"element_at({games}[0], -1) = 6 and element_at({games}[1], -1) = 6")


def valid(games: str = "games", points: str = "points") -> Column:
    """One to three sets, and points of a game, or numbers in a tie-break."""
    names = ", ".join(f"'{p}'" for p in POINTS)
    sets = F.expr(f"size({games}[0]) between 1 and 3")
    plain = F.expr(f"forall({points}, p -> p in ({names}))")
    numbers = F.expr(f"forall({points}, p -> p rlike '^[0-9]+$')")
    return F.coalesce(sets & F.when(tiebreak(games), numbers).otherwise(plain), F.lit(False))


def progress(games: str = "games") -> Column:
    """Sets so far and games of the current set in one ordered number."""
    return F.expr(f"size({games}[0]) * 1000 + element_at({games}[0], -1) + element_at({games}[1], -1)")


def clean_sequence(states: DataFrame) -> DataFrame:
    """Rows of ``match, ord`` with ``kept``: valid and in order with both neighbours.

    An ordered fold, since the previous neighbour is one that was kept while the
    next is any valid one. One array per match, which has a few hundred reads.
    """
    s = states.withColumn("p", F.when(valid(), progress()))
    ahead = Window.partitionBy("match").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("nxt", F.last("p", ignorenulls=True).over(ahead))
    rows = s.groupBy("match").agg(F.array_sort(F.collect_list(F.struct("ord", "p", "nxt"))).alias("r"))
    fold = F.expr(
        "aggregate(r, named_struct('prev', cast(null as int), 'kept', cast(array() as array<int>)), (a, c) -> "
        "if(c.p is null or (a.prev is not null and c.nxt is not null and a.prev <= c.nxt"
        " and (c.p < a.prev or c.p > c.nxt)), a,"
        " named_struct('prev', c.p, 'kept', concat(a.kept, array(c.ord)))), a -> a.kept)"
    )
    kept = rows.select("match", F.explode(fold).alias("ord")).withColumn("kept", F.lit(True))
    return states.join(kept, ["match", "ord"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def _won(a0: str, b0: str, a1: str, b1: str) -> str:
    return f"case when {b0} - {a0} = 1 and {b1} - {a1} = 0 then 0 when {b0} - {a0} = 0 and {b1} - {a1} = 1 then 1 end"


def point_winner(a: str, b: str) -> Column:
    """Team that won the one point between two states (structs); null if not one point."""
    rank = "case {} when '0' then 0 when '15' then 1 when '30' then 2 when '40' then 3 when 'A' then 4 when 'AD' then 4 when 'AV' then 4 end"
    p = [rank.format(f"{s}.points[{i}]") for s in (a, b) for i in (0, 1)]
    n = [f"try_cast({s}.points[{i}] as int)" for s in (a, b) for i in (0, 1)]
    named = " and ".join(f"({x}) is not null" for x in p)
    same = (
        f"case when {named} then coalesce({_won(f'({p[0]})', f'({p[2]})', f'({p[1]})', f'({p[3]})')},"
        f" case when ({p[2]}) - ({p[0]}) = -1 and ({p[3]}) = ({p[1]}) and ({p[0]}) = 4 then 1"
        f" when ({p[3]}) - ({p[1]}) = -1 and ({p[2]}) = ({p[0]}) and ({p[1]}) = 4 then 0 end)"
        f" else {_won(n[0], n[2], n[1], n[3])} end"
    )
    last = lambda s, i, k: f"try_element_at({s}.games[{i}], {k})"
    game = _won(last(a, 0, -1), last(b, 0, -1), last(a, 1, -1), last(b, 1, -1))
    new_set = _won(last(a, 0, -1), last(b, 0, -2), last(a, 1, -1), last(b, 1, -2))
    return F.expr(
        f"case when {a} is null or {b} is null then null when {a}.games = {b}.games then {same}"
        f" when forall({b}.points, x -> x = '0') then"
        f" case when size({a}.games[0]) = size({b}.games[0]) then {game}"
        f" when size({b}.games[0]) = size({a}.games[0]) + 1 then {new_set} end end"
    )


def point_winners(states: DataFrame) -> DataFrame:
    """Winner of the point between each state and the next of its match; where that
    is none, between it and the state after the next."""
    w = Window.partitionBy("match").orderBy("ord")
    me = states.withColumn("s", F.struct("games", "points"))
    me = me.withColumns({"n1": F.lead("s", 1).over(w), "n2": F.lead("s", 2).over(w)})
    return me.select("match", "ord", F.coalesce(point_winner("s", "n1"), point_winner("s", "n2")).cast("int").alias("winner"))


def last_score(states: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """``match, line, story`` from the last valid state of each match.

    teams: ``match, team_a, team_b``; without it, and for a match that is not in it, they are A and B.
    """
    last = states.where(valid()).groupBy("match").agg(F.max_by(F.struct("games", "points"), "ord").alias("s"))
    last = last.select("match", "s.games", "s.points").withColumns(
        {"tb": tiebreak(), "sets": F.arrays_zip(F.col("games")[0].alias("a"), F.col("games")[1].alias("b"))}
    )
    none = F.lit(None).cast("string")
    last = last.withColumns({"team_a": none, "team_b": none}) if teams is None else last.join(teams.select("match", "team_a", "team_b"), "match", "left")
    last = last.withColumns({"team_a": F.coalesce("team_a", F.lit("A")), "team_b": F.coalesce("team_b", F.lit("B"))})
    sets = F.array_join(F.expr("transform(sets, (g, i) -> concat('set ', i + 1, ': ', g.a, '-', g.b))"), " · ")
    now = F.concat(F.when(F.col("tb"), "tie-break ").otherwise("game "), F.col("points")[0], F.lit("-"), F.col("points")[1])
    line = F.concat(F.col("team_a"), F.lit(" vs "), F.col("team_b"), F.lit(" — "), sets, F.lit(" ("), now, F.lit(")"))
    lead = lambda x, y: f"case when {x} > {y} then concat(' (', team_a, ' leads)') when {y} > {x} then concat(' (', team_b, ' leads)') else '' end"
    pa, pb = "cast(points[0] as int)", "cast(points[1] as int)"
    story = F.expr(
        "array_join(transform(sets, (g, i) -> case"
        " when i + 1 < size(sets) then concat('Set ', i + 1, ' won by ', if(g.a > g.b, team_a, team_b), ' (', greatest(g.a, g.b), '-', least(g.a, g.b), ').')"
        f" when tb then concat('Set ', i + 1, ' at 6-6, tie-break: ', points[0], '-', points[1], if(tb, {lead(pa, pb)}, ''), '.')"
        f" else concat('Set ', i + 1, ' under way: ', g.a, '-', g.b, {lead('g.a', 'g.b')}, '.') end), ' ')"
    )
    return last.select("match", line.alias("line"), story.alias("story"))
