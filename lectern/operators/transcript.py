"""Transcripts and translations: cues, paragraphs, states, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import han_letters, latin_letters, strip
from lectern.sources.tables import spread

STOPS = ",.!?;:，。！？、；："
#: What speech recognition makes of silence.
NOISE = ("Thanks for watching", "[BLANK_AUDIO]", "字幕由", "字幕志愿者", "中文字幕志愿者", "请点赞", "请不吝点赞", "优优独播", "明镜需要您的支持", "MBC 뉴스")
_TIME = "([0-9]+):([0-9]{2}):([0-9]{2})[,.]([0-9]{1,3})"


def seconds(stamp: Column) -> Column:
    """h:mm:ss,ms as seconds."""
    part = lambda i: F.regexp_extract(stamp, _TIME, i).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def srt_cues(docs: DataFrame) -> DataFrame:
    """(doc, idx, start, end, text) of subtitles (doc, text); a cue's lines joined by blanks, empty cues left out."""
    blocks = F.filter(F.split(F.regexp_replace("text", "\\r\\n?", "\n"), "\\n\\s*\\n"), lambda b: b.rlike(f"{_TIME}\\s*-->\\s*{_TIME}"))
    rows = docs.select("doc", F.posexplode(blocks).alias("at", "b"))
    line = F.regexp_extract("b", f"({_TIME})\\s*-->\\s*({_TIME})", 1), F.regexp_extract("b", f"({_TIME})\\s*-->\\s*({_TIME})", 6)
    text = F.trim(F.regexp_replace(F.regexp_extract("b", f"(?s)-->\\s*{_TIME}[^\\n]*\\n(.*)$", 5), "\\s*\\n\\s*", " "))
    rows = rows.select("doc", "at", seconds(line[0]).alias("start"), seconds(line[1]).alias("end"), text.alias("text")).where("text <> ''")
    return rows.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1).alias("idx"), "start", "end", "text")


def stamp(second: Column, srt: bool = False) -> Column:
    """Seconds as hh:mm:ss,mmm, or as mm:ss, with hours where there are any."""
    s = F.floor(second).cast("long")
    h, m, r = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))
    text = lambda c: c.cast("string")
    two = lambda c: F.when(c.between(0, 9), F.concat(F.lit("0"), text(c))).otherwise(text(c))
    if srt:
        ms = F.pmod(F.round(second * 1000).cast("long"), F.lit(1000))
        return F.concat(two(h), F.lit(":"), two(m), F.lit(":"), two(r), F.lit(","), F.lpad(text(ms), 3, "0"))
    minutes = F.concat(two(m), F.lit(":"), two(r))
    return F.when(h > 0, F.concat(text(h), F.lit(":"), minutes)).otherwise(minutes)


def to_srt(cues: DataFrame) -> DataFrame:
    """(doc, text): the cues (doc, idx, start, end, text) as subtitles."""
    row = F.struct("idx", F.concat_ws("\n", F.col("idx") + 1, F.concat(stamp(F.col("start"), True), F.lit(" --> "), stamp(F.col("end"), True)), "text").alias("t"))
    return cues.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), "\n\n").alias("text"))


def in_order(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The rows with `__nth`, from 1 on within their key: a key's rows lie in a row, by `pos`, so that one pass over a partition reads all its keys."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(F.col(pos).asc_nulls_last())))


def _cues(gap_ms: int, max_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, start, last, before, talk, n = [], [], None, None, "", None, 0

        def close():
            nonlocal n
            rows.append((talk, n, start / 1000, last / 1000, "".join(words).strip()))
            n += 1

        def told():
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()), strict=True)], ["talk", "idx", "start", "end", "text"])

        for batch in batches:
            for nth, of, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if nth == 1:
                    if words:
                        close()
                    talk, words, before, n = of, [], "", 0
                if text == "<end>" or a is None or b is None:
                    continue
                opens = not words or text[:1].isspace() or before[-1:] in STOPS and before != ""
                if words and opens and (a - last > gap_ms or b - start > max_ms):
                    close()
                    words = []
                if not words:
                    start = a
                words.append(text)
                last, before = b, text
            yield told()
            rows = []
        if words:
            close()
            yield told()

    return run


def group_cues(tokens: DataFrame, gap_ms: int = 700, max_ms: int = 8000) -> DataFrame:
    """Tokens (talk, pos, text, start_ms, end_ms) as cues (talk, idx, start, end, text).

    A cue ends after a pause of more than `gap_ms` or before it gets longer than `max_ms`, but just where a
    word begins. As the length counts from the cue's own begin, it takes a pass; one reads all talks of a partition.
    """
    rows = in_order(tokens, "talk", "pos").select("__nth", F.col("talk").cast("long"), "text", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"))
    return rows.mapInArrow(_cues(gap_ms, max_ms), "talk long, idx long, start double, end double, text string")


def _paragraphs(seconds_: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, begin = 0, None
        for batch in batches:
            nth, *times = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(batch.num_columns - 3, batch.num_columns))
            out = []
            for first, a, b in zip(nth, *times, strict=True):
                if first == 1:
                    number, begin = 0, None
                if begin is None:
                    begin = a
                out.append(number)
                if b - begin >= seconds_:
                    number, begin = number + 1, None
            kept = batch.num_columns - 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(out, pa.int64())], [*batch.schema.names[:kept], "paragraph"])

    return run


def paragraphs(cues: DataFrame, seconds_: float = 45) -> DataFrame:
    """Cues with their paragraph's number; a paragraph ends with the cue that reaches `seconds_` from its begin. One pass reads all talks of a partition."""
    rows = in_order(cues, "talk", "idx").select(*cues.columns, "__nth", F.col("start").cast("double").alias("__start"), F.col("end").cast("double").alias("__end"))
    return rows.mapInArrow(_paragraphs(seconds_), cues.withColumn("paragraph", F.lit(0).cast("long")).schema)


def transcript_states(segments: DataFrame, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """(doc, n, uniq, chars, noise, state) of segments (doc, text): empty, dead or live, by the first rule that holds.

    Dead are transcripts of blank audio (at least 3 and 40 %), with 8 noise phrases, of at least 10 segments
    less than a quarter of them distinct, and of under 200 characters.
    """
    hits = sum(((F.length("text") - F.length(F.replace("text", F.lit(p), F.lit("")))) / len(p)).cast("int") for p in noise)
    blank = F.col("text").contains("[BLANK_AUDIO]").cast("int")
    a = segments.groupBy("doc").agg(F.count("text").alias("n"), F.coalesce(F.try_divide(F.countDistinct("text"), F.count("text")), F.lit(0.0)).alias("uniq"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(hits), F.lit(0)).alias("noise"), F.coalesce(F.sum(blank), F.lit(0)).alias("blank"))
    dead = (F.col("blank") >= F.greatest(F.lit(3.0), F.col("n") * 0.4)) | (F.col("noise") >= 8) | ((F.col("n") >= 10) & (F.col("uniq") < 0.25)) | (F.col("chars") < 200)
    return a.withColumn("state", F.when(F.col("n") == 0, "empty").when(dead, "dead").otherwise("live")).drop("blank")


_CUE = "^\\s*`?\\[(?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}\\]`?\\s*(.*)$"


def transcript_verdicts(docs: DataFrame, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """(doc, state, n, uniq, chars, noise, reason) of transcripts (doc, body) as Markdown with a time stamp before each cue.

    By the first rule that holds: empty without a stamped line; dead of blank audio (3 cues at least, and 40 %), of 8 noise
    phrases anywhere in the body, of at least 10 cues of which less than a quarter are distinct, of under 200 characters; else live.
    """
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\\R"), lambda x: x.rlike(_CUE))
    cues = docs.select("doc", F.coalesce("body", F.lit("")).alias("body"), F.transform(lines, lambda x: strip(F.regexp_extract(x, _CUE, 1))).alias("cues"))
    n = F.size("cues")
    hits = sum(((F.length("body") - F.length(F.replace("body", F.lit(p), F.lit("")))) / len(p)).cast("long") for p in noise)
    a = cues.select(
        "doc", n.cast("long").alias("n"), F.coalesce(F.try_divide(F.size(F.array_distinct("cues")), n), F.lit(0.0)).alias("uniq"),
        F.aggregate("cues", F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias("chars"), F.when(n > 0, hits).otherwise(0).alias("noise"), F.size(F.filter("cues", lambda x: x.contains("[BLANK_AUDIO]"))).alias("blank"),
    )
    reason = (
        F.when(F.col("n") == 0, "no_cues").when(F.col("blank") >= F.greatest(F.lit(3.0), F.col("n") * 0.4), "blank_audio").when(F.col("noise") >= 8, "noise")
        .when((F.col("n") >= 10) & (F.col("uniq") < 0.25), "repetition").when(F.col("chars") < 200, "too_short").otherwise("usable")
    )
    state = F.when(F.col("reason") == "no_cues", "empty").when(F.col("reason") == "usable", "live").otherwise("dead")
    return a.withColumn("reason", reason).withColumn("state", state).drop("blank")


LEAST_SOURCE = 200
LEAST_RATIO = 0.22
LEAST_PAGES = 3


def page_ratios(pages: DataFrame, target: Column | None = None, source: Column | None = None) -> DataFrame:
    """(doc, pair, ratio): letters of each odd page's translation on the even page after it, over its own; pairs with too little source left out, a last page alone too."""
    source = latin_letters(F.col("text")) if source is None else source
    target = han_letters(F.col("text")) if target is None else target
    p = pages.select("doc", F.floor((F.col("page") - 1) / 2).cast("long").alias("pair"), F.when(F.col("page") % 2 == 1, source).alias("s"), F.when(F.col("page") % 2 == 0, target).alias("t"))
    both = p.groupBy("doc", "pair").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    return both.where(f"s >= {LEAST_SOURCE} and t is not null").select("doc", "pair", (F.col("t") / F.col("s")).alias("ratio"))


def coverage(ratios: DataFrame, least: float = LEAST_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(doc, pages, median, verdict): abstain under `least_pages`, else pass from `least` on."""
    a = ratios.groupBy("doc").agg(F.count("*").alias("pages"), F.median(F.col("ratio").cast("double")).alias("median"))
    return a.withColumn("verdict", F.when(F.col("pages") < least_pages, "abstain").when(F.col("median") >= least, "pass").otherwise("fail"))


def weakest(ratios: DataFrame, k: int = 5) -> DataFrame:
    """The k lowest ratios of each document."""
    return ratios.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("ratio", "pair"))).where(F.col("rank") <= k)


def primary_engine(runs: DataFrame, preference: tuple[str, ...] = tuple("soniox whisper apple parakeet".split())) -> DataFrame:
    """(talk, engine): the engine liked best among those whose runs (talk, engine, n_segments) aren't empty."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("engine"))
    return runs.where("n_segments > 0").groupBy("talk").agg(F.min_by("engine", F.struct(F.when(rank > 0, rank).otherwise(99), "engine")).alias("engine"))


def agreed_entries(maps: DataFrame) -> DataFrame:
    """(k, v): entries of maps (map_id, k, v) that all maps hold with the same value."""
    n = maps.agg(F.countDistinct("map_id").alias("n_maps"))
    # by map first, so nothing is counted distinct by key, and least and largest values tell whether all are one
    each = spread(maps, maps.count(), "k").groupBy("k", "map_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    by = each.groupBy("k").agg(F.min("lo").alias("v"), F.max("hi").alias("hi"), F.count("map_id").alias("in_maps"))
    return by.crossJoin(F.broadcast(n)).where("v = hi and in_maps = n_maps").select("k", "v")  # one row
