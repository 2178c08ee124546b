"""Line deduplication by a segment-partition edit join. DataFrame operations only.

Lines (after trimming spaces) that are equal, or at most one edit apart,
directly or through others, form a class; of each class the first line in order
of document and position stays. An edit replaces, inserts or removes a
character in lines of at least ``MIN_LINE_CHARS`` characters, or a whole word in
lines of at least ``MIN_LINE_WORDS`` words, so an edit is a tenth of a line at
most; every line that is not blank takes part, shorter ones by equality only.

First each line is cut into two halves, and only lines that share a half with
another go on (``meeting_lines``); its length is rounded down for that, so a line has little more than
two keys. The texts of all others are neither moved nor cut any further.

The join cuts a line into threshold-plus-one segments, here two. Two lines one
edit apart agree outside one of the segments, so each line enters an index
under (length, edited segment, hash of all before it, hash of all behind it),
once by its own length, where the edit replaces something, and once as the
longer partner of lines one shorter, where it inserts something. Keys that hold
a single line are dropped by an aggregation with partial sums; the lines of the
others go on to the next round, in which the segment that may hold the edit is
split further, until it is a single character or word. Then all lines of a key
are at most one edit apart, so each is linked to the first of its key only, and
never all with all. Each link is verified by a banded bit-parallel edit
distance, and a component search joins the links into classes.

A larger threshold would lose this: lines that share a segment are then often
not linked, and a frequent segment would have to be paired all with all.

Edge cases: null or empty texts have no lines and come back unchanged. A
document whose lines are all removed has an empty text. Rows that repeat both
id and text are one document and keep the same lines. Ties cannot occur, as
(id, text hash, position) orders all lines. An empty table gives an empty
result. Columns of the input other than the text come back as they came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, join_keyed, materialize
from .components import connected_components

MIN_LINE_CHARS = 16
MIN_LINE_WORDS = 10
#: What a blank line consists of.
WHITE = " \t\n\x0B\f\r"
#: Pieces that a segment is split into in each later round.
FAN_OUT = 16
#: Leading bits of a line's length that decide how much of it is a key at first.
LEVEL_BITS = 3
#: Keys that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Unit:
    """What an edit changes: SQL forms of a line's length and parts in these units."""

    name: str
    least: int
    #: Length of a line, its first ``a`` units, those from ``a`` (from 1) on where it has ``size`` words, both as text,
    #: and units ``a + 1 .. b`` as an array.
    length: str
    head: str
    tail: str
    part: str


CHARACTERS = Unit("characters", MIN_LINE_CHARS, "length({x})", "left({x}, {a})", "substring({x}, {a})", "split(substring({x}, {a} + 1, {b} - {a}), '')")
# Words are told apart by single spaces, so a number of words joined by them is as good as their array, and cheaper to hash.
_WORDS = "(octet_length({x}) - octet_length(replace({x}, ' ', '')) + 1)"
WORDS = Unit(
    "words", MIN_LINE_WORDS, _WORDS, "substring_index({x}, ' ', {a})", "substring_index({x}, ' ', least(0, {a} - 1 - {size}))",
    "slice(split({x}, ' '), {a} + 1, greatest({b} - {a}, 0))",
)
UNITS = (CHARACTERS, WORDS)


def _of_unit(form: str, **parts: str) -> str:
    """A form of the line's own ``unit``, its place in ``UNITS``."""
    characters, words = (getattr(u, form).format(**parts) for u in UNITS)
    return f"if(unit = 0, {characters}, {words})"


def _row_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "h", F.xxhash64("text")
    )


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, h, pos, line, id`` of every line that is not blank."""
    return (
        _row_key(docs)
        .select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .where(F.ltrim("raw", F.lit(WHITE)) != "")
        .select("doc_id", "h", "pos", F.trim("raw").alias("line"))
        .withColumn("id", F.xxhash64("line", F.length("line")))
    )


def _level(size: str) -> str:
    """A length with its leading ``LEVEL_BITS`` bits only, so that few lengths have another level than the length below."""
    low = f"greatest(0, cast(floor(log2({size})) as int) - {LEVEL_BITS - 1})"
    return f"shiftleft(shiftright({size}, {low}), {low})"


def _halves(lines: DataFrame) -> DataFrame:
    """``id, part, key``: keys of which lines one edit apart share one at least, and equal lines all.

    All but one of the shorter line's n units are the same at the front and at the back of both lines, so
    they agree in their first or in their last m units wherever 2 * m <= n. m is half of n's
    level; a line that begins a level has the keys of the level below too, as its
    partner may be one shorter. Words serve for edits of characters as well, as these change one word, join two or
    part one; characters serve for lines of few words only. One word fewer than ``MIN_LINE_WORDS`` may be either
    case, so such lines have both. Lines that take part by equality only have their id as key.
    """
    words, chars = WORDS.length.format(x="line"), CHARACTERS.length.format(x="line")
    least = MIN_LINE_WORDS - 1
    sized = lines.select("id", "line", F.expr(words).alias("words"), F.expr(chars).alias("chars"))
    half = lambda size: f"({_level(size)} div 2)"
    # Positive for words, negative for characters.
    halves = f"""array(
      CASE WHEN words >= {least} THEN {half("words")} WHEN chars >= {MIN_LINE_CHARS} THEN -{half("chars")} ELSE 0 END,
      CASE WHEN words = {least} AND chars >= {MIN_LINE_CHARS} THEN -{half("chars")} END,
      CASE WHEN words > {least} THEN if({_level("(words - 1)")} < {_level("words")}, {half("(words - 1)")}, null)
        WHEN chars > {MIN_LINE_CHARS} AND {_level("(chars - 1)")} < {_level("chars")} THEN -{half("(chars - 1)")} END)"""
    cut = sized.select("id", "line", F.explode(F.expr(halves).cast("array<int>")).alias("half")).where("half is not null")
    before = "if(half > 0, substring_index(line, ' ', half), left(line, -half))"
    behind = "if(half > 0, substring_index(line, ' ', -half), substring(line, half))"
    keys = f"if(half = 0, array(id), array(xxhash64(0, half, {before}), xxhash64(1, half, {behind})))"
    return cut.select("id", F.posexplode(F.expr(keys)).alias("part", "key"))


def meeting_lines(lines: DataFrame) -> DataFrame:
    """``doc_id, h, pos, id, line`` of all lines that may equal another or be one edit apart; ``line`` only for the latter.

    Texts are read for their keys and for what is found; only keys are counted and joined.
    """
    pairs = materialize(_halves(lines), "line-pairs")
    n_first = F.count_if(F.col("part") == 0)
    keys = pairs.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), n_first.alias("n"), F.count("*").alias("n_rows"))
    keys = materialize(keys.where("a < b or n > 1").select("key", F.expr("a < b").alias("near"), "n_rows"), "line-keys")
    small = keys.count() <= BROADCAST_KEYS
    met = pairs.join(F.broadcast(keys.drop("n_rows")), "key") if small else join_keyed(pairs, keys, "key")
    # A line has each of its keys once, so that its keys are no fewer than its places.
    ids = met.groupBy("id").agg(F.max("near").alias("near"), F.count("*").alias("n_rows"))
    ids = materialize(ids, "line-ids", instead_of=(pairs, keys))
    found = lines.join(F.broadcast(ids.drop("n_rows")), "id") if few(ids) else join_keyed(lines, ids, "id")
    return materialize(found.select("doc_id", "h", "pos", "id", F.expr("if(near, line, null)").alias("line")), "line-places", instead_of=(ids,))


def _key() -> Column:
    """Index key of a line whose edit may lie in [lo, hi) of the shorter line."""
    before, behind = _of_unit("head", x="line", a="lo"), _of_unit("tail", x="line", a="(hi + longer + 1)", size="(n + longer)")
    return F.expr(f"xxhash64(unit, n, lo, hi, {before}, {behind})")


def _first_keys(lines: DataFrame) -> DataFrame:
    """Two segments of each line in characters and in words, by its own length and as the longer partner."""
    sizes = F.array(*[F.struct(F.lit(k).alias("unit"), F.expr(u.length.format(x="line")).alias("size"), F.lit(u.least).alias("least")) for k, u in enumerate(UNITS)])
    sized = lines.select("id", "line", F.inline(F.filter(sizes, lambda u: u["size"] >= u["least"])))
    sized = sized.select("id", "line", "unit", "size", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    sized = sized.withColumn("n", F.col("size") - F.col("longer"))
    half = F.floor(F.col("n") / 2).cast("int")
    # An insertion may also lie behind the last unit.
    ranges = F.array(
        F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("n").alias("hi"))
    )
    return sized.select("id", "line", "unit", "longer", "n", F.inline(ranges)).withColumn("key", _key())


def _split(rows: DataFrame) -> DataFrame:
    """Splits the segment of each row into up to ``FAN_OUT`` parts."""
    step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / FAN_OUT)).cast("int")
    cut = rows.withColumn("step", step).select(
        "id", "line", "unit", "longer", "n", "hi", "step", F.explode(F.expr("sequence(lo, greatest(lo, hi - 1), step)")).alias("at")
    )
    # A single position: an insertion may lie before or behind it.
    out = cut.select(
        "id", "line", "unit", "longer", "n", F.col("at").alias("lo"), F.least(F.col("at") + F.col("step"), F.col("hi")).alias("hi")
    )
    return out.withColumn("key", _key())


def _shared(rows: DataFrame) -> DataFrame:
    """Keys under which at least two different lines lie."""
    return rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")


def _with_shared(rows: DataFrame, keys: DataFrame) -> DataFrame:
    keys = materialize(keys, "line-keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, "key", "left_semi")


def within_one_edit(a: str, b: str) -> Column:
    """Banded bit-parallel test of two arrays of characters or words: at most one edit apart.

    Both are made once a row, as fields of ``p``, whatever the optimizer puts in place of their names.

    Bit d of ``r0`` and ``r1`` says that the first i units of b match the
    first i + d - 1 of a with no or at most one edit; three diagonals suffice.
    """
    step = """
      aggregate(
        sequence(0, size(p.b) - 1),
        struct(2 AS r0, 6 AS r1),
        (acc, i) -> named_struct(
          'r0', acc.r0 & m(i),
          'r1', ((acc.r1 & m(i)) | acc.r0 | shiftright(acc.r0, 1) | shiftleft(acc.r0 & m(i), 1)) & 7),
        acc -> shiftright(acc.r1, size(p.a) - size(p.b) + 1) & 1)
    """
    mask = (
        "(if(i > 0 and get(p.a, i - 1) = get(p.b, i), 1, 0) + if(get(p.a, i) <=> get(p.b, i), 2, 0)"
        " + if(i + 1 < size(p.a) and get(p.a, i + 1) = get(p.b, i), 4, 0))"
    )
    near = f"abs(size(p.a) - size(p.b)) <= 1 AND {step.replace('m(i)', mask)} = 1"
    return F.expr(f"exists(array(struct({a} AS a, {b} AS b)), p -> {near})")


def near_lines(lines: DataFrame) -> DataFrame:
    """Links ``u, v`` between the ids of different lines one edit apart, in characters or in words.

    Both units go through the same rounds, so the lines are read twice in all.
    """
    first = _first_keys(lines)
    rows = _with_shared(first, _shared(first))
    same = ["id", "unit", "longer", "n", "lo", "hi"]
    rows = materialize(rows.groupBy(*same).agg(F.first("line").alias("line")), "line-rows")
    widest = rows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    while widest > 1:
        parts = _split(rows)
        rows = materialize(_with_shared(parts, _shared(parts)).select(*same, "line"), "line-rows", instead_of=(rows,))
        widest = rows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    # Replacements: lines of equal length that agree but for one unit.
    # Insertions: the longer line has one more unit at either side of it.
    # A member of a key: what it has before ``at`` and from ``rest`` on is shared.
    swap = rows.where("longer = 0").select(
        "id", "unit", "line", F.col("lo").alias("at"), F.col("hi").alias("rest"), F.lit(0).alias("kind")
    )
    put = rows.select("id", "unit", "line", "longer", F.explode(F.array("lo", "hi")).alias("at")).select(
        "id", "unit", "line", "at", (F.col("at") + F.col("longer")).alias("rest"), F.lit(1).alias("kind")
    )
    size = _of_unit("length", x="line")
    outer = lambda x, rest: [_of_unit("head", x=x, a="at"), _of_unit("tail", x=x, a=f"({rest} + 1)", size=_WORDS.format(x=x))]
    mine, theirs = outer("line", "rest"), outer("head.line", "head.rest")
    members = swap.unionByName(put).withColumn("key", F.expr(f"xxhash64(unit, kind, {size} - rest + at, at, {', '.join(mine)})"))
    heads = members.groupBy("key").agg(F.min(F.struct("id", "line", "rest")).alias("head"))
    links = members.join(heads, "key").where("id <> head.id")
    # One of the keys that a pair shares is enough to verify it.
    links = links.groupBy("id", F.col("head.id").alias("other"), "unit").agg(F.min(F.struct("at", "rest", "line", "head")).alias("m"))
    links = links.select("id", "other", "unit", "m.*").withColumns(
        {
            "a": F.expr("greatest(at - 2, 0)"),
            "same": F.expr(" AND ".join(f"{x} = {y}" for x, y in zip(mine, theirs, strict=True))),
        }
    )
    # With the outer parts compared, the edit distance is that of the part between,
    # taken with two units of either side.
    x, y = (F.expr(_of_unit("part", x=f"{c}line", a="a", b=f"({c}rest + 2)")) for c in ("", "head."))
    links = links.where("same").select("id", "other", x.alias("x"), y.alias("y")).where(within_one_edit("x", "y"))
    return links.select(F.col("id").alias("u"), F.col("other").alias("v")).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, h, removed``: positions of the lines that do not stay."""
    lines = meeting_lines(lines_of(docs))
    roots = connected_components(near_lines(lines.where("line is not null")))
    place = F.struct("doc_id", "h", "pos")
    seen = lines.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    seen = materialize(
        seen.join(roots, F.col("id") == F.col("node"), "left")
        .where("root is not null or first <> last")
        .select("id", "first", F.coalesce("root", "id").alias("root")),
        "line-classes",
    )
    low = seen.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("n_rows"))
    stays = join_keyed(seen.drop("first"), low, "root").select("id", "first")
    gone = (
        lines.select("doc_id", "h", "pos", "id").join(stays, "id").where(F.struct("doc_id", "h", "pos") != F.col("first"))
    )
    return gone.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("removed"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents with the removed lines taken out of ``text``.

    Adds ``n_lines`` and ``n_removed``.
    """
    gone = removed_lines(docs).withColumnsRenamed({"doc_id": "__doc", "h": "__hash", "removed": "__removed"})
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__h": F.xxhash64(F.col("text").cast("string"))})
    joined = keyed.join(gone, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__hash")), "left")
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(__removed, i)), '\\n')")
    out = joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(F.split("text", "\n")), F.lit(0)),
            "n_removed": F.coalesce(F.size("__removed"), F.lit(0)),
            "__text": F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept),
        }
    )
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_removed")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Pipeline form: same columns; documents of removed lines only go.

    A column ``n_chars`` follows the text.
    """
    out = line_dedup(docs).where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
