"""Scalar functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock(seconds: str | Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour; fractions are cut off."""
    s = F.floor(_col(seconds)).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def clean_answer(text: str | Column) -> Column:
    """Takes reasoning blocks and stray tags out of a model's answer."""
    no_blocks = F.regexp_replace(_col(text), "(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(no_blocks, "</?think>", ""))


def first_json(text: str | Column, schema: str) -> Column:
    """The widest ``{...}`` of a text, parsed; null where there is none or it is broken."""
    return F.from_json(F.regexp_extract(_col(text), r"(?s)\{.*\}", 0), schema)


#: Corners of a picture in which a scoreboard may stand.
CORNERS = ("haut_gauche", "haut_droite", "bas_gauche", "bas_droite")


def one_of(answer: str | Column, known: tuple[str, ...], default: str | None = None) -> Column:
    """A model's answer, trimmed and in lower case, if it is one of the known; else the default."""
    c = F.lower(F.trim(_col(answer)))
    return F.when(c.isin(*known), c).otherwise(F.lit(default))


def even_fit(side: Column, width: Column, height: Column, size: int) -> Column:
    """One side scaled so that the longer is ``size``; even, never enlarged, 2 at least."""
    scale = F.least(F.lit(1.0), F.lit(float(size)) / F.greatest(width, height))
    return F.greatest(F.lit(2), (F.bround(side * scale / 2) * 2).cast("int"))


def has_word(text: str | Column) -> Column:
    return _col(text).rlike(r"[\p{L}\p{N}_]")


def first_duration(*texts: str | Column) -> Column:
    """First of the texts that is a positive number."""
    values = [F.expr(f"try_cast({t} AS double)") if isinstance(t, str) else t.try_cast("double") for t in texts]
    return F.coalesce(*[F.when((v > 0) & ~F.isnan(v), v) for v in values])


def turn_of(rotation: str | Column) -> Column:
    """Picture turn for a clockwise rotation tag, as filter steps."""
    turn = F.pmod(-_col(rotation), F.lit(360))
    return (
        F.when(turn == 90, "transpose=1").when(turn == 180, "hflip,vflip").when(turn == 270, "transpose=2").otherwise("")
    )


def file_slug(name: str | Column) -> Column:
    return F.regexp_replace(_col(name), "[^A-Za-z0-9.-]+", "_")


def own_half(x: str | Column, y: str | Column, far: Column) -> tuple[Column, Column]:
    """(lateral, depth) as seen from a player's own half of a 10 x 20 court."""
    return F.when(far, 10 - _col(x)).otherwise(_col(x)), F.abs(_col(y) - 10)


NET_ZONE, SERVICE_LINE = 4.0, 6.95


def zone(depth: str | Column) -> Column:
    """Court zone by distance to the net."""
    d = _col(depth)
    return F.when(d < NET_ZONE, "net").when(d < SERVICE_LINE, "transition").otherwise("back")


def merged_class(label: str | Column) -> Column:
    """Class that a stroke label counts as; null where it is to be ignored."""
    c = _col(label)
    return F.when(c.isin("bandeja", "vibora", "bandeja_ou_vibora"), "bandeja_vibora").when(c != "incertain", c)


def report_key(stroke: str | Column) -> Column:
    """Stroke as a report counts it: the two sliced overheads are one."""
    c = _col(stroke)
    return F.when(c.isin("bandeja", "vibora"), "bandeja_vibora").otherwise(c)


#: The rate that per-frame thresholds were tuned at, and how far a video's may lie over it.
POSE_FPS, RATE_SLACK = 30.0, 1.05


def pose_fps(native: str | Column) -> Column:
    """Rate at which poses of a video are sampled: its own, or ``POSE_FPS`` where that is clearly higher."""
    c = _col(native)
    return F.when(c > POSE_FPS * RATE_SLACK, F.lit(POSE_FPS)).otherwise(c)


def short_team(team: str | Column) -> Column:
    """First player of a team's name, in title case."""
    return F.initcap(F.trim(F.element_at(F.split(_col(team), "/"), 1)))


def player_name(team: str | Column, role: str | Column) -> Column:
    """Name of a player by team and side."""
    return F.concat_ws(" · ", _col(team), _col(role))


#: Capital letters of the Latin blocks whose decomposition is a plain letter and marks, and that letter.
_MARKED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.upper() and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
ACCENTED = "".join(_MARKED)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def plain_name(name: str | Column) -> Column:
    """Upper case without accents, whether they are part of a letter or marks of their own."""
    upper = F.upper(F.replace(_col(name), F.lit("ß"), F.lit("ss")))
    return F.regexp_replace(F.translate(upper, ACCENTED, PLAIN), r"\p{Mn}", "")
