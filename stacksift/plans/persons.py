"""Queries over credit lines. Lines are made from customers by rule: a name, and what stands behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, persons
from ..operators.checkpoint import spread
from ..sources.readers import parquet
from .registry import query

NAMES = ["陳志文", "王大文", "李文", "黃伯和", "邁爾", "梁淑儀", "C. S. Lewis", "馮 煒 文", "伊爾文", "托馬斯‧奧登", "曾思瀚&鄧紹光", "圖登嘉措", "白立德著", "尹可名"]
ENDINGS = ["", "著", " 著", "主編", " 主編", "等著", "譯者", " 譯者", "新編", "撰著", "主編著", "和著", "文", " 文", "/圖", " 等", "原著", "-譯", "著 呂妙芬譯", "◎審訂", "共同主編"]
LINES = ["文/圖", "等", "其他", "圖", "王小明；李四", "王小明、李四", "序 走在信心之路的你……", "經文引用:和合本", "著:王小明", "ISBN:9789571234567", "李志秋 書號：9789571234567", "Anselm Gr&uuml", "(王小明", "規格 13.6cm", " ", "A,B,C 之友", "圖/賽卓"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey and line, in even partitions."""
    k = F.col("c_custkey")
    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    made = F.concat(at(NAMES, k % len(NAMES)), at(ENDINGS, F.floor(k / len(NAMES)) % len(ENDINGS)))
    return spread(parquet(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.when(k % 4 == 0, at(LINES, F.floor(k / 4) % len(LINES))).otherwise(made).alias("line"))


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_CTE = f"""lines as (select c_custkey, case when c_custkey % 4 = 0 then ({_sql(LINES)})[(c_custkey // 4) % {len(LINES)} + 1] else ({_sql(NAMES)})[c_custkey % {len(NAMES)} + 1] || ({_sql(ENDINGS)})[(c_custkey // {len(NAMES)}) % {len(ENDINGS)} + 1] end as line from customer)"""
_ROLES = f"map({_sql(persons.ROLE_WORDS)}, {_sql(persons.ROLE_WORDS.values())})"
_TRIM = r"regexp_replace({0}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"
_GLUE = r"[\s\x{3000}\x{00B7}\x{2022}\x{FF65}\x{30FB}/\x{FF0F}\\]"


def _tail_sql(source: str) -> str:
    """CTE steps that take a note off column s of ``source`` (key c_custkey): table tails with t_clean, t_role, t_note, t_hold."""
    ends = lambda values: f"list_filter({_sql(values)}, lambda x: ends_with(s, x))"
    return rf"""
t1 as (select c_custkey, s, {ends(persons.TAIL_NOTES)}[1] as free, {ends(persons.SPACED_NOTES)}[1] as spaced, regexp_matches(s, '({"|".join(persons.TAIL_NOTES)})[\s\x{{3000}}／/\\.．、]+\S') as two from {source}),
t2 as (select *, coalesce(free, spaced) as note, spaced is not null and not regexp_matches(s[1:length(s) - length(spaced)], '{_GLUE}$') as glued from t1),
t3 as (select *, regexp_replace(s[1:length(s) - length(note)], '{_GLUE}+$', '') as rest from t2),
t4 as (select *, case when two then 'two credits' when glued then 'glued' when note is null or rest = '' then null when length(rest) < 2 then 'short' when map_contains({_ROLES}, rest) then 'role'
  when regexp_matches(rest, '[\s\x{{3000}}][等合和與及暨]$|[,，、；;/／\\－—-]$|[◎○●★☆◆·‧．]$|\.+$') then 'dangling'
  when length(note) = 1 and regexp_matches(rest, '[&＆.．、,，/／]') and regexp_matches(rest, '[和合與及暨等]$') then 'half'
  when len(list_filter({_sql(persons.TAIL_NOTES + persons.RESIDUE)}, lambda x: ends_with(rest, x))) > 0 then 'again' end as t_hold from t3),
tails as (select c_custkey, s as t_in, t_hold, case when t_hold is null and note is not null and rest <> '' then note end as t_note, case when t_hold is null and note is not null and rest <> '' then rest else s end as t_clean,
  case when t_hold is null and note is not null and rest <> '' then coalesce({_ROLES}[note], {_ROLES}[right(note, 2)], {_ROLES}[right(note, 1)]) end as t_role from t4)"""


@query(f"with {_CTE}, src as (select c_custkey, {_TRIM.format('line')} as s from lines), {_tail_sql('src')} select c_custkey, t_clean as clean, t_role as role, t_note as note, t_hold as hold from tails")
def name_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note at the end of a name taken off, or the reason why it stays."""
    return _lines(spark, sf_dir).select("c_custkey", F.inline(F.array(persons.tail_note(F.col("line"))))).select("c_custkey", "clean", "role", "note", "hold")


_OPEN, _CLOSE = "(（[［【", ")）]］】"
_count = lambda chars: f"len(list_filter(string_split(s, ''), lambda x: contains('{chars}', x) and x <> ''))"
_LABEL_PARTS = r"list_filter(regexp_split_to_array(regexp_replace({0}, '[\s\x{{3000}}]+', '', 'g'), '[/／\\、；;,，&＆]'), lambda x: x <> '')"
_NO_ROLES = "len(list_filter({0}, lambda x: map_contains({1}, x))) < greatest(1, len({0}))"
_FLAGS = rf"""list_filter([case when length(s) > 25 then 'long' end, case when regexp_matches(s, '[。！？]|\.\.\.|…') then 'sentence' end, case when {_count(",，")} >= 2 then 'commas' end,
 case when {_count(_OPEN)} <> {_count(_CLOSE)} then 'brackets' end,
 case when label <> '' and {_NO_ROLES.format(_LABEL_PARTS.format("label"), _ROLES)} then 'label' end,
 case when regexp_matches(lower(s), '[0-9]+(\.[0-9]+)?\s*(cm|mm|公分|頁|元|×)') then 'measures' end], lambda x: x is not null)"""
_LABELLED = r"""select c_custkey, s, regexp_extract(s, '^([^:：]{1,8})[:：]', 1) as label"""


@query(f"with {_CTE}, src as ({_LABELLED} from (select c_custkey, {_TRIM.format('line')} as s from lines)) select c_custkey, array_to_string({_FLAGS}, ',') as flags from src where len({_FLAGS}) > 0")
def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are rather passages than names, with the reasons."""
    return _lines(spark, sf_dir).select("c_custkey", persons.long_text_flags(F.col("line")).alias("f")).where("size(f) > 0").select("c_custkey", F.array_join("f", ",").alias("flags"))


_ALT = "|".join(sorted(persons.ROLE_WORDS, key=lambda w: (-len(w), w)))
_ISBN13 = r"97[89]([\s\x{3000}-]?[0-9]){10}"
_trim = lambda x: r"regexp_replace(" + x + r", '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g')"
_head = lambda tail: _trim(f"regexp_extract(s0, '{tail}', 1)")
_labelled = lambda n: f"case when colon then regexp_extract(w, '{persons.COLON_LABEL}', {n}) else regexp_extract(w, '{persons.SLASH_LABEL}', {n}) end"
_WORD = r"regexp_extract(w0, '^(..+?)[\s\x{3000}－/／\\-]+(" + _ALT + ")$', "
_KIND = rf"""with {_CTE},
base as (select c_custkey, {_TRIM.format('line')} as s0 from lines),
parts as (select *, list_filter(regexp_split_to_array(s0, '[/／\\、；;,，&＆:：\s\x{{3000}}]+'), lambda x: x <> '') as p from base),
cut as (select *, coalesce(nullif({_head(r"^(.+?)[\s\x{3000}]*((ISBN|書號|书号)[\s\x{3000}]*[:：]?[\s\x{3000}]*" + _ISBN13 + ".*)$")}, ''), {_head(r"^(.+?)[\s\x{3000}]+(出版[\s\x{3000}]*[:：].*)$")}) as c0 from parts),
whole as (select *, case when c0 <> '' then c0 else s0 end as w from cut),
label as (select *, regexp_matches(w, '{persons.COLON_LABEL}') as colon from whole),
l2 as (select *, {_labelled(1)} as l0, {_trim(_labelled(2))} as r0 from label),
pre as (select *, not {_NO_ROLES.format(_LABEL_PARTS.format("l0"), _ROLES)} as prefixed, {_ROLES}[({_LABEL_PARTS.format("l0")})[1]] as l_role from l2),
w1 as (select *, case when prefixed then r0 else w end as w0 from pre),
w2 as (select *, {_trim(_WORD + "1)")} as wn, {_WORD}2) as ww from w1),
w3 as (select *, ww <> '' and length(wn) >= 2 and not map_contains({_ROLES}, wn) as hit, ww in ('文', '圖', '作') and regexp_matches(wn, '^\S([\s\x{{3000}}]+\S)+$') as spread from w2),
w4 as (select *, case when hit and not spread then wn else w0 end as s, case when hit and not spread then {_ROLES}[ww] end as w_role from w3),
{_tail_sql('w4')},
flags as ({_LABELLED} from (select c_custkey, w as s from whole)),
f as (select c_custkey, {_FLAGS} as fl from flags),
j as (select w4.*, t_hold, t_note, t_clean, t_role, fl, (prefixed or w_role is not null or t_note is not null) and regexp_matches(t_clean, '[:：/／\\]') as dirty from w4 join tails using (c_custkey) join f using (c_custkey)),
k as (select *, case when s0 = '' then 'clean'
 when len(p) >= 2 and len(list_filter(p, lambda x: map_contains({_ROLES}, x) or list_contains({_sql(persons.FILLERS)}, x))) = len(p) then 'role_word'
 when contains(s0, '；') then 'fullwidth_semi' when regexp_matches(s0, '[;、]') then 'needs_resplit' when regexp_matches(s0, '&#?[A-Za-z0-9]{{1,8}};?$') then 'entity'
 when regexp_matches(s0, '^((ISBN|書號|书号)[\s\x{{3000}}]*[:：]?[\s\x{{3000}}]*)?{_ISBN13}$') then 'filler'
 when list_contains({_sql(persons.FILLERS)}, regexp_replace(w, '[\s\x{{3000}}]+', '', 'g')) then 'filler' when map_contains({_ROLES}, w) then 'role_word' when len(fl) > 0 then 'long_text'
 when prefixed and length(r0) < 2 then 'role_prefix' else 'notes' end as first_kind from j)
select c_custkey, case when first_kind <> 'notes' then first_kind when w_role is not null or t_note is not null or t_hold is not null then 'tail_note' when prefixed then 'role_prefix' when c0 <> '' then 'tail_note' else 'clean' end as kind,
 case when first_kind in ('role_word', 'filler') then '' when first_kind <> 'notes' or t_hold is not null or dirty then w else t_clean end as clean,
 case when first_kind = 'role_word' and len(p) < 2 then {_ROLES}[w] when first_kind <> 'notes' or t_hold is not null or dirty then null else coalesce(case when prefixed then l_role end, w_role, t_role) end as role,
 case when first_kind in ('fullwidth_semi', 'needs_resplit') then 'split' when first_kind = 'entity' then 'decode' when first_kind = 'long_text' then array_to_string(fl, ',') when first_kind = 'role_prefix' then 'short' when first_kind <> 'notes' then null when t_hold is not null then t_hold when dirty then 'structure' end as hold
from k"""


@query(_KIND)
def name_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line is: nobody, several people, a passage, or a name with or without notes."""
    lines = _lines(spark, sf_dir)
    several = F.when(persons.trimmed(F.col("line")).rlike("[;、]"), 2).otherwise(1)
    return lines.select("c_custkey", F.inline(F.array(persons.name_kind(F.col("line"), several))))


_USUAL = f"translate(nm, '{''.join(persons.VARIANTS.values())}', '{''.join(persons.VARIANTS)}')"
_GLYPHS = ["黃文峰", "黄文峯", "黃文峯", "吳恆", "吴恒", "衛羣", "臺灣", "台灣", "奧古斯丁"]


@query(f"with n as (select distinct ({_sql(_GLYPHS)})[c_custkey % 9 + 1] || (c_custkey % 5) as nm, c_nationkey from customer), k as (select nm, c_nationkey, {_USUAL} as usual from n) select a.nm as a, b.nm as b, a.c_nationkey as nation from k a join k b on a.usual = b.usual and a.c_nationkey = b.c_nationkey and a.nm < b.nm")
def glyph_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names that differ in the writing of characters only."""
    c = parquet(spark, sf_dir, "customer")
    name = F.concat(F.get(F.array(*[F.lit(g) for g in _GLYPHS]), (F.col("c_custkey") % 9).cast("int")), (F.col("c_custkey") % 5).cast("string"))
    n = c.select(name.alias("nm"), F.col("c_nationkey").alias("nation")).distinct().withColumn("usual", persons.usual_glyphs(F.col("nm")))
    return n.withColumnRenamed("nm", "a").join(n.withColumnRenamed("nm", "b"), ["usual", "nation"]).where("a < b").select("a", "b", "nation")


@query(f"with {_CTE}, src as (select c_custkey, {_TRIM.format('line')} as s from lines), {_tail_sql('src')}, known as (select distinct t_in as nm from tails) select t_note as note, count(*) as stripped, count(nm) as merged, round(100.0 * count(nm) / count(*), 4) as percent from tails left join known on nm = t_clean where t_note is not null group by 1")
def merge_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each note: how many names it was taken off, and how many of the results are names that stand in the table too."""
    lines = _lines(spark, sf_dir).select(persons.trimmed(F.col("line")).alias("s"))
    t = lines.select(F.inline(F.array(persons.tail_note(F.col("s"))))).where("note is not null").groupBy("note", "clean").agg(F.count("*").alias("n"))
    made = t.join(lines.select(F.col("s").alias("nm")).distinct(), F.col("clean") == F.col("nm"), "left")
    made = made.groupBy("note").agg(F.sum("n").alias("stripped"), F.sum(F.when(F.col("nm").isNotNull(), F.col("n")).otherwise(0)).alias("merged"))
    return made.withColumn("percent", F.round(100 * F.col("merged") / F.col("stripped"), 4))


@query(f"""with {_CTE}, src as (select c_custkey, {_TRIM.format('line')} as s from lines), {_tail_sql('src')},
found as (select c_custkey as item, t_clean as person, coalesce(t_role, 'author') as role from tails where t_hold is null and t_clean <> ''),
old as (select c_custkey as item, t_in as person, 'author' as role from tails where c_custkey % 3 = 0)
select item, person, role, 'old' as origin from old union all select item, person, role, 'new' from found where not exists (select 1 from old where old.item = found.item and old.person = found.person and old.role = found.role)""")
def resplit_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between items and people after a new split: missing ones are added, none is taken away, a held name adds nobody."""
    lines = _lines(spark, sf_dir).select(F.col("c_custkey").alias("item"), persons.trimmed(F.col("line")).alias("s"))
    old = lines.where("item % 3 = 0").select("item", F.col("s").alias("person"), F.lit("author").alias("role"))
    t = lines.select("item", F.inline(F.array(persons.tail_note(F.col("s")))))
    found = t.where("hold is null and clean <> ''").select("item", F.col("clean").alias("person"), F.coalesce("role", F.lit("author")).alias("role"))
    return old.withColumn("origin", F.lit("old")).unionByName(found.join(old, ["item", "person", "role"], "left_anti").withColumn("origin", F.lit("new")))


@query("""
with l as (select c_custkey, case c_custkey % 4 when 0 then '文:甲' || c_custkey || '、圖:乙丙' when 1 then '甲' || c_custkey || '著 乙丙譯' when 2 then '甲' || c_custkey || ';乙丙' else '甲' || c_custkey end as n from customer)
select c_custkey, 0 as place, '甲' || c_custkey as name, case c_custkey % 4 when 0 then 'author' when 1 then 'author' end as role from l
union all select c_custkey, 1, '乙丙', case c_custkey % 4 when 0 then 'illustrator' when 1 then 'translator' end from l where c_custkey % 4 < 3
""")
def credit_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit lines of every form split into people with roles."""
    k, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    line = F.when(kind == 0, F.concat(F.lit("文:甲"), k, F.lit("、圖:乙丙"))).when(kind == 1, F.concat(F.lit("甲"), k, F.lit("著 乙丙譯"))).when(kind == 2, F.concat(F.lit("甲"), k, F.lit(";乙丙"))).otherwise(F.concat(F.lit("甲"), k))
    c = parquet(spark, sf_dir, "customer").select("c_custkey", line.alias("credit"))
    return names.people(c, "c_custkey", "credit").select("c_custkey", "place", "name", "role")


#: Credit lines by form, each with the people in it: place, name, credit, role, kind, hold. {k} is the key.
FORMS = [
    ("R. FUREY{k}，PH.D.", [(0, "R. FUREY{k}，PH.D.", "R. FUREY{k}，PH.D.", None, "clean", None)]),
    ("M. Kennedy{k}，S.J.；李四{k}", [(0, "M. Kennedy{k}，S.J.", "M. Kennedy{k}，S.J.", None, "clean", None), (1, "李四{k}", "李四{k}", None, "clean", None)]),
    ("責任編輯：李四{k}", [(0, "李四{k}", "責任編輯：李四{k}", "editor", "role_prefix", None)]),
    ("著者：王五{k}、譯者：趙六", [(0, "王五{k}", "著者：王五{k}", "author", "role_prefix", None), (1, "趙六", "譯者：趙六", "translator", "role_prefix", None)]),
    ("攝影／陳大{k}", [(0, "陳大{k}", "攝影／陳大{k}", "illustrator", "role_prefix", None)]),
    ("李四{k}；Jr.", [(0, "李四{k}", "李四{k}", None, "clean", None), (1, "Jr.", "Jr.", None, "clean", None)]),
    ("吳小{k}新編", [(0, "吳小{k}新編", "吳小{k}新編", None, "tail_note", "glued")]),
    ("曾思瀚&鄧{k}和著", [(0, "曾思瀚&鄧{k}和著", "曾思瀚&鄧{k}和著", None, "tail_note", "half")]),
    ("文、圖：王小{k}", [(0, "王小{k}", "王小{k}", "author", "clean", None), (1, "王小{k}", "王小{k}", "illustrator", "clean", None)]),
    ("文/圖", []),
    ("孔毅{k}（R. Kung，N.）；等", [(0, "孔毅{k}（R. Kung，N.）", "孔毅{k}（R. Kung，N.）", None, "clean", None)]),
    ("CLOUD&TOWNSEND{k}", [(0, "CLOUD&TOWNSEND{k}", "CLOUD&TOWNSEND{k}", None, "clean", None)]),
    ("{k}Gr&uuml", [(0, "{k}Gr&uuml", "{k}Gr&uuml", None, "entity", "decode")]),
    ("{k}Gr&uuml;n 著", [(0, "{k}Grün", "{k}Grün 著", "author", "tail_note", None)]),
    ("唐澄{k} ISBN ： 9789865524272", [(0, "唐澄{k}", "唐澄{k} ISBN ： 9789865524272", None, "tail_note", None)]),
    ("王小{k} 出版：校園", [(0, "王小{k}", "王小{k} 出版：校園", None, "tail_note", None)]),
    ("9789864001682、文亮{k}", [(1, "文亮{k}", "文亮{k}", None, "clean", None)]),
    ("李志{k}，張心瑋合著 書號：9789811438141", [(0, "李志{k}", "李志{k}", None, "clean", None), (1, "張心瑋", "張心瑋合著", "author", "tail_note", None)]),
    ("序 走在路上的你……{k}", [(0, "序 走在路上的你……{k}", "序 走在路上的你……{k}", None, "long_text", "sentence")]),
    ("王編", [(0, "王編", "王編", None, "tail_note", "short")]),
    ("文:江淑{k}\\圖:陳嘉鈴", [(0, "江淑{k}", "文:江淑{k}", "author", "role_prefix", None), (1, "陳嘉鈴", "圖:陳嘉鈴", "illustrator", "role_prefix", None)]),
    ("甲乙{k}著 (John) 丙丁譯", [(0, "甲乙{k}著 (John) 丙丁譯", "甲乙{k}著 (John) 丙丁譯", None, "tail_note", "two credits")]),
]
_text = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
_FORM_ROWS = ", ".join(f"({i}, {p[0]}, {', '.join(map(_text, p[1:]))})" for i, (_, people) in enumerate(FORMS) for p in people)


@query(f"""select c_custkey, place, replace(name, '{{k}}', c_custkey::varchar) as name, replace(credit, '{{k}}', c_custkey::varchar) as credit, role, kind, hold
from customer join (values {_FORM_ROWS}) as t(form, place, name, credit, role, kind, hold) on form = c_custkey % {len(FORMS)}""")
def credit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit lines of every form through the table function: who stands in them, in which role, and what is held for a reader."""
    k = F.col("c_custkey")
    line = F.get(F.array(*[F.lit(f) for f, _ in FORMS]), (k % len(FORMS)).cast("int"))
    c = parquet(spark, sf_dir, "customer").select("c_custkey", F.replace(line, F.lit("{k}"), k.cast("string")).alias("credit"))
    return names.people(c, "c_custkey", "credit")
