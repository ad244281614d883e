"""Record types: closed header schemas with their constraints, former names of types, and the sections that bodies have."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import strip


@dataclass(frozen=True)
class Field:
    """A header field. `low` and `high` bound a text's length, a number, or a list's size; `item` the length of a list's texts."""

    kind: str
    required: bool = False
    nullable: bool = False
    low: int | None = None
    high: int | None = None
    pattern: str | None = None
    choices: tuple[str, ...] = ()
    item: tuple[int, int] | None = None


def _text(low: int, high: int, required: bool = True, **more) -> Field:
    return Field("text", required, low=low, high=high, **more)


def _names(required: bool = True) -> Field:
    return Field("list", required, low=1 if required else 0, item=(2, 120))


TITLE, NAME, SHORT = _text(2, 280), _text(2, 120), _text(2, 200)
YEAR = Field("whole", True, True, 1500, 2030)
RATING = Field("whole", nullable=True, low=1, high=5)
TAGS = Field("list", low=0)
DOI = Field("text", nullable=True, low=0, high=1 << 30, pattern="^10\\.[0-9]+/.+")
DAY = Field("date", True)
ANY_DAY = Field("date", nullable=True)


def _choice(*values: str, required: bool = True) -> Field:
    return Field("choice", required, choices=values)


#: Fields by type, in the order in which headers are written; `type` is before them.
SCHEMAS: dict[str, dict[str, Field]] = {
    "author": {"name": NAME, "themes": TAGS, "topics": TAGS, "rating": RATING},
    "book": {
        "title": TITLE, "authors": _names(), "year": YEAR, "publisher": SHORT, "isbn": Field("code", nullable=True), "doi": DOI,
        "category": _choice("monograph", "edited-volume", "handbook", "other", required=False), "themes": TAGS, "topics": TAGS, "rating": RATING,
    },
    "chapter": {"title": TITLE, "authors": _names(), "year": YEAR, "book": SHORT, "themes": TAGS, "topics": TAGS, "rating": RATING},
    "image": {"title": TITLE, "creator": _names(False), "date": ANY_DAY, "source": _text(2, 500, False, nullable=True), "themes": TAGS, "topics": TAGS, "rating": RATING},
    "journal": {"title": TITLE, "kind": _choice("overview", "resources"), "journal": SHORT},
    "note": {"title": TITLE, "created": DAY, "annotates": Field("text", nullable=True), "themes": TAGS},
    "paper": {"title": TITLE, "authors": _names(), "year": YEAR, "journal": SHORT, "themes": Field("list", True, low=1), "doi": DOI, "topics": TAGS, "rating": RATING},
    "talk": {"title": TITLE, "date": DAY, "speaker": _names(False), "themes": TAGS, "rating": RATING, "media": SHORT},
    "topic": {
        "title": TITLE, "kind": _choice("overview", "resources", "outline", "card"), "subquestions": Field("list", nullable=True, low=1, high=6),
        "history": Field("list", nullable=True), "created": ANY_DAY, "themes": Field("list", nullable=True),
    },
    "transcript": {"title": TITLE, "talk": SHORT},
    "webpage": {
        "title": TITLE, "url": Field("address", True, low=8, high=2048), "captured_at": Field("moment", True), "authors": _names(False), "published": ANY_DAY,
        "site": _text(2, 200, False, nullable=True), "themes": TAGS, "topics": TAGS, "rating": RATING,
    },
}
_FORMER = {
    "author": "author-profile",
    "book": "book-analysis book-overview monograph monograph-analysis overview",
    "chapter": "book-chapter book_chapter chapter-analysis chapter-summary",
    "journal": "journal-synthesis",
    "paper": "article-analysis journal-article journal-article-analysis paper-analysis paper-summary",
    "topic": "citation-snowball-synthesis concept-note reading-list research-note snowball-synthesis topic-synthesis",
}
ALIASES = {old: new for new, names in _FORMER.items() for old in names.split()}


def canonical_type(raw: Column) -> Column:
    """The type itself if it is a present one, else what a former name stands for; null for others."""
    lookup = F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p])
    return F.when(raw.isin(*SCHEMAS), raw).otherwise(F.element_at(lookup, raw))


def type_bucket(raw: Column) -> Column:
    """struct(bucket, problem): the type or what a former name stands for (deprecated_type), _missing_type for null, else _unknown_type."""
    bucket = F.when(raw.isNull(), "_missing_type").otherwise(F.coalesce(canonical_type(raw), F.lit("_unknown_type")))
    problem = F.when(raw.isNull(), "missing_type").when(raw.isin(*SCHEMAS), None).when(raw.isin(*ALIASES), "deprecated_type").otherwise("unknown_type")
    return F.struct(bucket.alias("bucket"), problem.alias("problem"))


_MOMENT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.0+)?(Z|[+]00:00)$"


def _bounded(size: Column, f: Field, under: str, over: str) -> Column:
    out = F.lit(None).cast("string")
    if f.high is not None:
        out = F.when(size > f.high, over).otherwise(out)
    return out if f.low is None else F.when(size < f.low, under).otherwise(out)


def _code(f: Field, v: Column, kind: Column) -> Column:
    """What is wrong with a value that isn't null, given as text with its YAML kind (null where that isn't known)."""
    is_ = lambda *kinds: F.coalesce(kind.isin(*kinds), F.lit(True))
    if f.kind == "whole":
        return F.when(~is_("int") | ~v.rlike("^[+-]?[0-9]{1,9}$"), "int_type").otherwise(_bounded(v.try_cast("int"), f, "greater_than_equal", "less_than_equal"))
    if f.kind == "list":
        return F.when(~is_("list") | ~v.rlike("^\\["), "list_type").otherwise(_bounded(F.size(F.from_json(v, "array<string>")), f, "too_short", "too_long"))
    if f.kind == "date":
        return F.when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & v.try_cast("date").isNotNull(), None).otherwise("date_from_datetime_parsing")
    if f.kind == "moment":
        return F.when(v.rlike(_MOMENT) & v.try_cast("timestamp").isNotNull(), None).otherwise("value_error")
    if f.kind == "choice":
        return F.when(v.isin(*f.choices), None).otherwise("literal_error")
    if f.kind == "code":
        return F.when(~is_("str", "int"), "string_type")
    size = F.length(strip(v))
    if f.kind == "address":
        web = v.rlike("(?i)^\\s*https?://[^/?#@\\s]+([/?#]|\\s*$)")
        return F.when(~is_("str"), "string_type").otherwise(F.coalesce(_bounded(size, f, "string_too_short", "string_too_long"), F.when(~web, "value_error")))
    shape = F.when(~strip(v).rlike(f.pattern), "string_pattern_mismatch") if f.pattern else F.lit(None).cast("string")
    return F.when(~is_("str"), "string_type").otherwise(F.coalesce(_bounded(size, f, "string_too_short", "string_too_long"), shape))


_NULL_CODE = {"whole": "int_type", "list": "list_type", "date": "date_type", "moment": "datetime_type", "choice": "literal_error"}


def _found(field: Column, code: Column) -> Column:
    return F.struct(field.alias("field"), code.alias("code"))


def _errors(kind: str, fields: Column, kinds: Column) -> Column:
    """array(struct(field, code)) of a header of one type."""
    one = []
    for name, f in SCHEMAS[kind].items():
        v, k = F.element_at(fields, name), F.element_at(kinds, name)
        absent = F.lit("missing") if f.required else F.lit(None).cast("string")
        empty = F.lit(None).cast("string") if f.nullable else F.lit(_NULL_CODE.get(f.kind, "string_type"))
        code = F.when(~F.map_contains_key(fields, name), absent).when(v.isNull(), empty).otherwise(_code(f, v, k))
        one.append(_found(F.lit(name), code))
    plain = F.filter(F.array(*one), lambda e: e["code"].isNotNull())
    extra = F.transform(F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(n) for n in ("type", *SCHEMAS[kind])]))), lambda n: _found(n, F.lit("extra_forbidden")))
    parts = [plain, extra]
    for name, f in SCHEMAS[kind].items():
        if f.item:
            parts.append(_item_errors(name, f, F.element_at(fields, name)))
    if kind == "topic":
        parts.append(F.when(topic_fields_belong(fields), F.array().cast("array<struct<field:string,code:string>>")).otherwise(F.array(_found(F.lit("kind"), F.lit("value_error")))))
    return F.concat(*parts)


def _item_errors(name: str, f: Field, value: Column) -> Column:
    """array(struct(field, code)) of a list's texts, as authors.0 and so on."""

    def told(item: Column, n: Column) -> Column:
        size = F.length(strip(item))
        code = F.when(item.isNull(), "string_type").when(size < f.item[0], "string_too_short").when(size > f.item[1], "string_too_long")
        return _found(F.concat(F.lit(f"{name}."), n.cast("string")), code)

    found = F.filter(F.transform(F.from_json(value, "array<string>"), told), lambda e: e["code"].isNotNull())
    return F.coalesce(found, F.array().cast("array<struct<field:string,code:string>>"))


def topic_fields_belong(fields: Column) -> Column:
    """Whether a topic's page has the fields of its kind alone: an outline its questions, with ids of their own; created and themes just a card."""
    has = lambda n: F.element_at(fields, n).isNotNull()
    ids = F.from_json(F.element_at(fields, "subquestions"), "array<struct<id:string>>")["id"]
    outline = F.coalesce((F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))
    kind = F.element_at(fields, "kind")
    own = F.when(kind.eqNullSafe(F.lit("outline")), outline).otherwise(~has("subquestions") & ~has("history"))
    return own & (kind.eqNullSafe(F.lit("card")) | (~has("created") & ~has("themes")))


def header_violations(files: DataFrame) -> DataFrame:
    """(path, field, code) of files (path, type, fields map<string,string>, kinds map<string,string> if known).

    Values other than texts are given as JSON, `kinds` names their YAML kind (str, int, float, bool, list, map,
    date), so that the year "1999" can be told from 1999. A type that isn't a present one is the only fault told:
    deprecated_type or unknown_type, as are null fields (no_frontmatter).
    """
    kinds = F.col("kinds") if "kinds" in files.columns else F.create_map().cast("map<string,string>")
    told = F.array(_found(F.lit("type"), F.when(F.col("fields").isNull(), "no_frontmatter").when(F.col("type").isin(*ALIASES), "deprecated_type").otherwise("unknown_type")))
    found = F.when(F.col("fields").isNull() | ~F.coalesce(F.col("type").isin(*SCHEMAS), F.lit(False)), told)
    for kind in SCHEMAS:
        found = found.when(F.col("type") == kind, _errors(kind, F.col("fields"), F.coalesce(kinds, F.create_map().cast("map<string,string>"))))
    return files.select("path", F.explode(found).alias("v")).select("path", "v.field", "v.code")


def schema_snapshot(spark) -> DataFrame:
    """(type, required, fields): the names of the required fields, and of all in their order."""
    rows = [(t, [n for n, f in s.items() if f.required], list(s)) for t, s in sorted(SCHEMAS.items())]
    return spark.createDataFrame(rows, "type string, required array<string>, fields array<string>")


def artifact_contracts(spark) -> DataFrame:
    """(type, field_order, required, sections array<struct<h2,kind,required>>): what a record of each type with a body is made of."""
    rows = [(t, ["type", *SCHEMAS[t]], ["type", *[n for n, f in SCHEMAS[t].items() if f.required]], [(s.h2, s.kind, s.required) for s in BODIES[t]]) for t in sorted(BODIES)]
    return spark.createDataFrame(rows, "type string, field_order array<string>, required array<string>, sections array<struct<h2:string,kind:string,required:boolean>>")


@dataclass(frozen=True)
class Section:
    """A body's section: its heading, the shape of what is below it, and headings that stand for it."""

    h2: str
    kind: str
    required: bool = True
    aliases: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()

    def named(self, heading: str) -> bool:
        return heading == self.h2 or heading in self.aliases or any(re.match(p, heading) for p in self.patterns)


_TIES = ("^与 .+ 的关联$", '^与".+"的关联$')
_KEY, _QUOTED = Section("关键概念", "table"), ("可引用段落",)
_READ = (Section("核心论点", "paragraph"), Section("理论框架", "paragraph"), Section("分节摘要", "h3-sections"), _KEY, Section("核心引用", "numbered-list", aliases=("核心引用文献",)), Section("金句要点", "blockquote-list", False, _QUOTED))
BODIES: dict[str, tuple[Section, ...]] = {
    "author": (
        Section("思想肖像", "paragraph"), Section("代表著作", "paragraph", False, ("代表作概览",)), Section("学术轨迹", "paragraph"), Section("关键概念", "table", aliases=("核心概念谱系", "概念谱系")),
        Section("理论网络", "bullet-list"), Section("金句要点", "blockquote-list", aliases=("可引用观点", "可引用要点")),
        Section("项目关联", "h3-project-tabs", aliases=("与本项目主题的关联", "与项目主题的关联"), patterns=(*_TIES, "^与「.+」的关联$", "^与 BTS .+ 的关联$")),
    ),
    "book": (
        Section("核心论点", "paragraph", aliases=("一、全书核心论点", "全书核心论点")), Section("章节逻辑", "paragraph", aliases=("章节间逻辑",)),
        Section("关键概念", "table", aliases=("三、核心概念表", "关键概念表", "关键概念谱系", "核心概念表")), Section("理论贡献", "paragraph", aliases=("核心理论贡献",)),
        Section("精读章节", "numbered-list", aliases=("推荐精读章节",)), Section("项目关联", "h3-project-tabs", False, patterns=(*_TIES, "^与「.+」的关联$")),
    ),
    "chapter": (*_READ, Section("项目关联", "h3-project-tabs", False, patterns=(*_TIES, "^★+ 与 .+ 的关联$", "^与 BTS .+ 的关联$"))),
    "paper": (*_READ, Section("项目关联", "h3-project-tabs", False, patterns=(*_TIES, "^★+ 与 .+"))),
    "talk": (Section("核心论点", "paragraph"), Section("分节摘要", "h3-sections"), _KEY, *[Section(h, "bullet-list") for h in ("项目关联", "文献人物", "时间脉络")]),
    "webpage": (Section("Summary", "paragraph"), Section("Content", "freeform")),
}

_OPENS = re.compile(r"^\x20{0,3}([`]{3,}|[~]{3,})")
_LEVEL = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_SECOND = re.compile(r"^##\x20(?!#)(.+?)\s*$")
_SHAPES = (
    ("bullet-list", re.compile(r"[-*]\s")),
    ("numbered-list", re.compile(r"\d+\.\s")),
    ("table", re.compile(r"\|(?:.*\|)?$")),
    ("blockquote-list", re.compile(">")),
    ("definition-list", re.compile(r"\*\*[^*]{2,40}\*\*[:：]")),
)


def plain_lines(lines: list[str]):
    """(line, whether it is outside fenced code): a fence is closed by one of its sign, as long at least, with nothing behind it."""
    mark = ""
    for line in lines:
        m = _OPENS.match(line) if "```" in line or "~~~" in line else None
        if mark:
            yield line, False
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not line.strip().strip(mark[0]):
                mark = ""
        elif m:
            mark = m[1]
            yield line, False
        else:
            yield line, True


def kind_of(lines: list[str]) -> str:
    """The shape of most lines of a section (60 % at least, else mixed); h3 if it has headings of that level; empty."""
    deeper = any(line.startswith("### ") and not line.startswith("### #") for line in lines)
    rest = [x for x in (line.strip() for line in lines) if x and not re.match(r"#{3,}\s", x)]
    if deeper:
        return "h3"
    counts: dict[str, int] = {}
    for line, plain in plain_lines(rest):
        if plain:
            kind = next((k for k, p in _SHAPES if p.match(line) and (k != "table" or len(line) > 1)), "paragraph")
            counts[kind] = counts.get(kind, 0) + 1
    if not counts:
        return "empty"
    top = max(counts, key=counts.get)
    return top if counts[top] / sum(counts.values()) >= 0.6 else "mixed"


def body_faults(kind: str | None, body: str | None) -> list[dict]:
    """What is wrong with a body of a type: (fault, h2, expected, detected); see `body_violations`."""
    sections = BODIES.get(kind or "", ())
    lines = (body or "").split("\n")
    if not sections:
        return []
    told = lambda fault, h2=None, expected=None, detected=None: {"fault": fault, "h2": h2, "expected": expected, "detected": detected}
    told_lines = list(plain_lines(lines))
    heads = [(len(m[1]), m[2]) for line, plain in told_lines if plain and line.startswith("#") and (m := _LEVEL.match(line))]
    if heads and all(level > 2 for level, _ in heads):
        return [told("global_heading_level_drift", expected="2", detected=str(min(level for level, _ in heads)))]
    parts: list[tuple[str, list[str]]] = []
    for line, plain in told_lines:
        m = _SECOND.match(line) if plain and line.startswith("##") else None
        if m:
            parts.append((m[1].strip(), []))
        elif parts:
            parts[-1][1].append(line)
    out, seen = [], set()
    for heading, inner in parts:
        section = next((s for s in sections if s.named(heading)), None)
        if section is None:
            out.append(told("unknown_h2", heading))
            continue
        seen.add(section.h2)
        if section.h2 != heading:
            out.append(told("h2_alias", heading, section.h2))
        found = kind_of(inner)
        if section.kind.startswith("h3-"):
            wrong = found != "h3"
        elif section.kind == "freeform":
            wrong = found == "empty"
        else:
            wrong = found not in (section.kind, "empty")
        if wrong:
            soft = found == "mixed" and not section.kind.startswith("h3-") and section.kind != "freeform"
            out.append(told("block_kind_mismatch_soft" if soft else "block_kind_mismatch", section.h2, section.kind, found))
    for section in sections:
        if section.required and section.h2 not in seen:
            level = next((n for n, text in heads if n in (3, 4) and section.named(text)), None)
            out.append(told("heading_level_drift", section.h2, "2", str(level)) if level else told("missing_required_h2", section.h2))
    return out


ARROW_FAULTS = pa.list_(pa.struct([(n, pa.string()) for n in ("fault", "h2", "expected", "detected")]))
FAULTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("fault", "h2", "expected", "detected")]))


@F.arrow_udf(FAULTS)
def _body_faults(kind: pa.Array, body: pa.Array) -> pa.Array:
    return pa.array([body_faults(k, b) for k, b in zip(kind.to_pylist(), body.to_pylist(), strict=True)], ARROW_FAULTS)


def body_violations(files: DataFrame) -> DataFrame:
    """(path, fault, h2, expected, detected) of files (path, type, body).

    Sections that are missing, unknown, called by an old heading, on a deeper level, or of another shape than
    theirs; a body without any second-level heading has just that fault. Fenced code has no headings. A text is
    one state machine, so this is a vectorised Python function over Arrow batches.
    """
    return files.select("path", F.explode(_body_faults("type", "body")).alias("v")).select("path", "v.*")


RENAMED = T.StructType([T.StructField("body", T.StringType()), T.StructField("changes", T.ArrayType(T.StringType()))])


def with_present_headings(kind: str | None, body: str) -> tuple[str, list[str]]:
    sections, lines, changes = BODIES.get(kind or "", ()), [], []
    for line, plain in plain_lines(body.split("\n")):
        m = _SECOND.match(line) if plain else None
        section = next((s for s in sections if s.named(m[1].strip())), None) if m else None
        if section and section.h2 != m[1].strip():
            changes.append(f"heading {m[1].strip()} to {section.h2}")
            line = f"## {section.h2}"
        lines.append(line)
    return "\n".join(lines), changes


@F.pandas_udf(RENAMED)
def present_headings(kind: pd.Series, body: pd.Series) -> pd.DataFrame:
    """struct(body, changes): second-level headings outside fenced code by their present names."""
    return pd.DataFrame([(None, []) if b is None else with_present_headings(k, b) for k, b in zip(kind, body, strict=True)], columns=["body", "changes"])


FIELD_NAMES = {"score": "rating", "tags": "themes", "book_year": "year", "book_author": "authors", "chapter-author": "authors", **{f"{t}_title": "title" for t in ("chapter", "book", "paper")}}
#: Fields that no type has any more.
ORPHANS = frozenset(
    """analyzed analyzed_chapters avg_relevance chapter chapter_label chapters_analyzed chapters_available chapters_in_vault chapters_in_volume chapters_missing
    chapters_selected chapters_total citations concepts confidence date edition editors has-overview has-profile note notes overall_rating pages processed_chapters
    relevance reviewed_author reviewed_book round scope_note selection_note selective_reading slot slug source_file source_note source_type status structure supersedes
    tags paper_title terminal topic total_chapters translators version volume word_count_est""".split()
)


def _star_count(text: str) -> int | None:
    n = text.count("★")
    return n if 1 <= n <= 5 else None


def _whole_year(v) -> int | None:
    if isinstance(v, str) and re.fullmatch(r"\s*[0-9]{4}\s*", v):
        v = int(v)
    return v if isinstance(v, int) and not isinstance(v, bool) and 1500 <= v <= 2030 else None


def fixed_header(header: dict, path: str) -> tuple[dict, list[str]]:
    """A header after the repairs, and what they changed, in their order.

    The type to its present name; fields to theirs, unless the new one is filled; authors to a list without empty
    entries (an author has a name instead); stars to a number, other texts dropped; years to numbers or dropped; a
    chapter's book from its folder; fields that no type has dropped; an author's title to its name; themes to a list.
    """
    out, log = dict(header), []
    raw = out.get("type")
    kind = raw if raw in SCHEMAS else ALIASES.get(raw) if isinstance(raw, str) else None
    if kind and kind != raw:
        out["type"] = kind
        log.append(f"type {raw} to {kind}")
    for old, new in FIELD_NAMES.items():
        if old in out:
            if out.get(new) not in (None, "", [], {}):
                del out[old]
                log.append(f"dropped {old} for {new}")
            else:
                out[new] = out.pop(old)
                log.append(f"renamed {old} to {new}")
    if kind == "author":
        for name in ("author", "authors"):
            if name in out:
                del out[name]
                log.append(f"dropped {name}")
    elif "author" in out:
        if out.get("authors"):
            del out["author"]
            log.append("dropped author for authors")
        else:
            out["authors"] = out.pop("author")
            log.append("renamed author to authors")
    if "authors" in out:
        v = out["authors"]
        if v is None:
            del out["authors"]
            log.append("dropped authors")
        elif isinstance(v, str):
            out["authors"] = [v]
            log.append("authors to a list")
        elif isinstance(v, list) and (some := [s for s in v if isinstance(s, str) and s.strip()]) != v:
            out["authors"] = some
            log.append("authors without empty ones")
    if "rating" in out and (out["rating"] is None or isinstance(out["rating"], str)):
        stars = _star_count(out["rating"] or "")
        if stars is None:
            del out["rating"]
            log.append("dropped rating")
        else:
            out["rating"] = stars
            log.append("rating to a number")
    if "year" in out:
        year = _whole_year(out["year"])
        if year is None:
            if out.pop("year") is not None:
                log.append("dropped year")
        elif year != out["year"]:
            out["year"] = year
            log.append("year to a number")
    if kind == "chapter" and (m := re.search(r"(?:^|/)books/([^/]+)", path)):
        if out.get("book") != m[1]:
            out["book"] = m[1]
            log.append("book from the path")
        if "source" in out:
            del out["source"]
            log.append("dropped source for book")
    for name in list(out):
        if name in ORPHANS and not (kind == "talk" and name == "date"):
            del out[name]
            log.append(f"dropped {name}")
    if kind == "author" and "title" in out:
        title = out.pop("title")
        log.append("dropped title for name" if "name" in out else "renamed title to name")
        out.setdefault("name", title)
    if "themes" in out and not isinstance(out["themes"], list):
        if isinstance(out["themes"], str):
            out["themes"] = [out["themes"]]
            log.append("themes to a list")
        elif out["themes"] is None:
            out["themes"] = []
            log.append("themes to an empty list")
    return out, log


def in_order(header: dict, kind: str | None) -> dict:
    """The fields in the order of their type's schema, others behind them as they come."""
    names = [n for n in ("type", *SCHEMAS.get(kind or "", ())) if n in header]
    return {n: header[n] for n in (*names, *[n for n in header if n not in names])}


FIXED = T.StructType([T.StructField("header", T.StringType()), T.StructField("changes", T.ArrayType(T.StringType()))])


@F.pandas_udf(FIXED)
def fix_header(path: pd.Series, header: pd.Series) -> pd.DataFrame:
    """struct(header, changes) of headers as JSON objects; see `fixed_header`. A null header stays null."""
    rows = []
    for p, h in zip(path, header, strict=True):
        new, log = fixed_header(json.loads(h), p or "") if h is not None else (None, [])
        rows.append((None if new is None else json.dumps(in_order(new, new.get("type")), ensure_ascii=False), log))
    return pd.DataFrame(rows, columns=["header", "changes"])


REPAIRED_FILE = T.StructType([T.StructField("text", T.StringType()), T.StructField("changes", T.ArrayType(T.StringType()))])


def repaired_text(path: str, text: str) -> tuple[str, list[str]]:
    """A file's text after all repairs of its header and headings; unchanged if it has no header or no known type."""
    from lectern.sources.markdown import dumped, parsed

    header, body, error = parsed(text)
    if error or (header or {}).get("type") not in {*SCHEMAS, *ALIASES}:
        return text, []
    new, changes = fixed_header(header, path)
    body, renamed = with_present_headings(new["type"], body)
    new = {k: v for k, v in in_order(new, new["type"]).items() if v != []}
    out = f"---\n{dumped(new)}\n---\n{body}"
    return (text, []) if out == text else (out, [*changes, *renamed] or ["normalised"])


@F.pandas_udf(REPAIRED_FILE)
def repair_file(path: pd.Series, text: pd.Series) -> pd.DataFrame:
    """struct(text, changes) of whole files; applied twice it changes nothing more."""
    return pd.DataFrame([(None, []) if t is None else repaired_text(p or "", t) for p, t in zip(path, text, strict=True)], columns=["text", "changes"])


def chapter_tocs(files: DataFrame) -> DataFrame:
    """(book, chapters): for each folder its chapters (file, title) among files (path, type, title), by number, ch2 before ch10."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    number = F.regexp_extract(name, "^ch([0-9]+)", 1)
    slot = F.coalesce(F.when(number != "", number.try_cast("int")), F.lit(1 << 30))
    entry = F.struct(slot.alias("slot"), name.alias("file"), F.coalesce("title", F.lit("")).alias("title"))
    by = files.where("type = 'chapter'").groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("book")).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    return by.select("book", F.transform("c", lambda x: F.struct(x["file"], x["title"])).alias("chapters"))


def toc_report(tocs: DataFrame) -> DataFrame:
    """(book, text): each book's chapters as a Markdown list under its heading."""
    line = lambda c: F.concat(F.lit("- `"), c["file"], F.lit("` — "), c["title"])
    head = F.concat(F.lit("## "), "book", F.lit(" ("), F.size("chapters"), F.lit(" chapters)"))
    return tocs.select("book", F.concat_ws("\n", head, F.lit(""), F.array_join(F.transform("chapters", line), "\n")).alias("text"))


def manifest_faults(chapters: DataFrame) -> DataFrame:
    """(book, slot, code) of chapter manifests (book, slot, filename, start, end, size, sha256, observed_sha256).

    size is null where the file isn't there. A book's slots and file names must be well-formed and its own; files there, not
    empty, and as told; page pairs in order.
    """
    from pyspark.sql import Window

    twice = lambda c: F.count("*").over(Window.partitionBy("book", c)) > 1
    fault = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("slot").rlike("^[0-9]+[a-z]*$"), F.lit(False)) | twice("slot"), "slot"),
            F.when(~F.coalesce(F.col("filename").rlike("(?i)^[^/]+\\.txt$"), F.lit(False)), "unsafe_filename"),
            F.when(twice("filename"), "filename"),
            F.when(F.coalesce("size", F.lit(0)) <= 0, "chapter_set_incomplete"),
            F.when(F.col("sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("observed_sha256")), "chapter_set_mismatch"),
            F.when(~valid_page_pair(F.col("start"), F.col("end")), "manifest_page_range_invalid"),
        )
    )
    return chapters.withColumn("__fault", fault).select("book", "slot", F.explode("__fault").alias("code"))


def valid_page_pair(start: Column, end: Column) -> Column:
    """Neither page, or both from 1 on and in order."""
    return (start.isNull() & end.isNull()) | F.coalesce((start >= 1) & (start <= end), F.lit(False))


def safe_chapter_filename(name: Column, slot: Column) -> Column:
    """The name if it is `slot`_….txt, of one path segment and at most 128 characters, else null."""
    good = F.startswith(name, F.concat(slot, F.lit("_"))) & name.rlike("\\.txt$") & ~name.rlike("[/\\\\]|\\.\\.") & (F.length(name) <= 128)
    return F.when(good, name)
