"""Names of people as column expressions: notes at the end, what kind of line a name is, long texts, glyph variants.

Nothing here guesses: where a note cannot be told from a part of the name, or what would remain is no clean name,
the name stays as it is and ``hold`` says why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role words with the role that each stands for.
ROLE_WORDS = {
    "文": "author", "著": "author", "作": "author", "著者": "author", "作者": "author", "編著": "author", "合著": "author", "口述": "author", "撰": "author",
    "編": "editor", "主編": "editor", "編輯": "editor", "編者": "editor", "總編輯": "editor", "責任編輯": "editor", "校訂": "editor", "審訂": "editor", "選編": "editor", "彙編": "editor", "編撰": "editor", "編寫": "editor",
    "譯": "translator", "譯者": "translator", "翻譯": "translator", "編譯": "translator", "譯著": "translator",
    "圖": "illustrator", "繪": "illustrator", "繪圖": "illustrator", "插圖": "illustrator", "插畫": "illustrator", "漫畫": "illustrator", "攝影": "illustrator",
}
# Notes that may be taken off the end of a name, in the order in which they are tried.
TAIL_NOTES = (
    "共同主編", "共同編著", "共同編譯", "共同編", "共同著", "共同譯", "主編著", "主編譯",
    "等人合著", "等人合編", "合編著", "等合著", "等合編", "等編著", "撰著",
    "責任編輯", "總編輯", "等主編", "等著", "等編", "等譯",
    "原文編譯", "總審訂", "原著", "編選", "編註", "新譯", "改寫", "改編", "審校",
    "編輯", "主編", "編著", "合著", "合編", "編譯", "譯著", "編撰", "編寫",
    "校訂", "審訂", "審譯", "選編", "彙編", "口述", "著", "編", "譯", "等",
)
# Notes that need a separator before them, endings that show an unknown compound note, lines that are nobody.
SPACED_NOTES = ("著者", "作者", "編者", "譯者", "繪者", "新編", "校對")
RESIDUE = ("撰", "述", "輯", "繪", "攝", "主")
AMBIGUOUS = ("文", "圖", "作")
FILLERS = ("等", "等人", "其他", "其它", "無", "不詳", "N/A", "n/a", "-")
# Usual writing and other writings of one character.
VARIANTS = {
    "托": "託", "啟": "啓", "峰": "峯", "群": "羣", "為": "爲", "秘": "祕", "裡": "裏", "傑": "杰", "奧": "奥", "內": "内", "真": "眞",
    "溫": "温", "衛": "衞", "卻": "却", "查": "査", "恆": "恒", "郎": "郞", "吳": "吴", "黃": "黄", "俞": "兪", "褚": "禇", "昇": "升",
    "於": "于", "絕": "絶", "麼": "麽", "瑯": "琅", "冰": "氷", "戶": "户", "污": "汙", "緣": "縁", "每": "毎", "叟": "叜", "臺": "台",
}
GLUE = r"[\s\x{3000}\x{00B7}\x{2022}\x{FF65}\x{30FB}/\x{FF0F}\\]"
BLANKS = r"[\s\x{3000}]+"
DANGLING = r"(?:[\s\x{3000}][等合和與及暨]|[,，、；;/／\\\-－—]|[◎○●★☆◆·‧．]|\.+)$"
MANY, HALF = r"[&＆.．、,，/／]", r"[和合與及暨等]$"
LONG, SHORTEST = 25, 2
COLON_LABEL, SLASH_LABEL = r"^([^:：]{1,12})[:：][ \t\x{3000}]*(.+)$", r"^([^:：/／]{1,12})[/／][ \t\x{3000}]*(.+)$"
LABEL_CUTS = r"[/／\\、；;,，&＆]"
SENTENCE, SPEC, LABEL = r"[。！？]|\.{3}|…", r"(?i)\d+(?:\.\d+)?\s*(?:cm|mm|公分|頁|元|×)", r"^([^:：]{1,8})[:：]"
CUTS = r"[/／\\、；;,，&＆:：\s\x{3000}]+"
ISBN = r"97[89](?:[\s\x{3000}\-]?\d){10}"
BIBLIO = r"(?:ISBN|書號|书号)"
#: Behind a name: a book number with its label, or a publisher with a colon.
BOOK_TAILS = (r"^(.+?)[\s\x{3000}]*(?:" + BIBLIO + r"[\s\x{3000}]*[:：]?[\s\x{3000}]*" + ISBN + r".*)$", r"^(.+?)[\s\x{3000}]+(?:出版[\s\x{3000}]*[:：].*)$")
BOOK_ONLY = r"^(?:" + BIBLIO + r"[\s\x{3000}]*[:：]?[\s\x{3000}]*)?" + ISBN + "$"
#: What is left of an HTML reference, whatever its name.
REFERENCE = r"&#?[A-Za-z0-9]{1,8};?$"


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it; a column in its place is copied each time."""
    return F.transform(F.array(value), then)[0]


def role_of(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_WORDS.items() for x in kv]), word)


def role_of_note(note: Column) -> Column:
    return F.coalesce(role_of(note), role_of(F.right(note, F.lit(2))), role_of(F.right(note, F.lit(1))))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\s\x{3000}]+|[\s\x{3000}]+$", "")


def label_roles(label: Column) -> Column:
    """The roles of a label such as one word, or several joined; null unless every part is a role word."""
    parts = F.filter(F.split(F.regexp_replace(label, BLANKS, ""), LABEL_CUTS), lambda p: p != "")
    return let(F.transform(parts, role_of), lambda roles: F.when((F.size(roles) > 0) & F.forall(roles, lambda r: r.isNotNull()), roles))


def role_prefix(s: Column) -> Column:
    """struct(role, rest) of a role label in front, else null: behind it a colon, or without any colon a slash in its place."""

    def labelled(s: Column, form: Column) -> Column:
        part = lambda n: F.when(form == 1, F.regexp_extract(s, COLON_LABEL, n)).otherwise(F.regexp_extract(s, SLASH_LABEL, n))
        found = let(label_roles(part(1)), lambda r: F.when(r.isNotNull(), F.struct(r[0].alias("role"), trimmed(part(2)).alias("rest"))))
        return F.when(form > 0, found)

    return let(s, lambda s: let(F.when(s.rlike(COLON_LABEL), 1).when(s.rlike(SLASH_LABEL), 2).otherwise(0), lambda form: labelled(s, form)))


def tail_note(s: Column) -> Column:
    """struct(clean, role, note, hold): the longest note at the end taken off, or why it must not be."""
    return let(trimmed(s), _tail_note)


def _tail_note(s: Column) -> Column:
    first = lambda notes: F.get(F.filter(_words(notes), lambda n: F.endswith(s, n)), F.lit(0))
    head = lambda note: F.left(s, F.char_length(s) - F.char_length(note))
    none = lambda why: F.struct(s.alias("clean"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("note"), F.lit(why).cast("string").alias("hold"))

    def verdict(note: Column, c: Column) -> Column:
        again = F.exists(_words(TAIL_NOTES + RESIDUE), lambda n: F.endswith(c, n))
        why = (
            F.when(F.char_length(c) < SHORTEST, "short").when(role_of(c).isNotNull(), "role").when(c.rlike(DANGLING), "dangling")
            .when((F.char_length(note) == 1) & c.rlike(MANY) & c.rlike(HALF), "half").when(again, "again")
        )
        taken = lambda why: F.struct(F.when(why.isNull(), c).otherwise(s).alias("clean"), F.when(why.isNull(), role_of_note(note)).alias("role"), F.when(why.isNull(), note).alias("note"), why.alias("hold"))
        return let(why, taken)

    def cut(note: Column) -> Column:
        return let(F.regexp_replace(head(note), GLUE + "+$", ""), lambda rest: F.when(rest == "", none(None)).otherwise(verdict(note, rest)))

    def judged(spaced: Column) -> Column:
        glued = spaced.isNotNull() & ~head(spaced).rlike(GLUE + "$")
        noted = let(F.coalesce(first(TAIL_NOTES), spaced), lambda note: F.when(note.isNull(), none(None)).otherwise(cut(note)))
        return F.when(glued, none("glued")).otherwise(noted)

    two = s.rlike("(?:" + "|".join(TAIL_NOTES) + r")[\s\x{3000}／/\\.．、]+\S")
    return F.when(two, none("two credits")).otherwise(let(first(SPACED_NOTES), judged))


def long_text_flags(s: Column) -> Column:
    """Why a text is rather a passage than a name; empty for a name."""
    return let(trimmed(s), _long_text_flags)


def _long_text_flags(s: Column) -> Column:
    no_label = let(F.regexp_extract(s, LABEL, 1), lambda label: (label != "") & label_roles(label).isNull())
    depth = F.char_length(F.regexp_replace(s, r"[^(（\[［【]", "")) - F.char_length(F.regexp_replace(s, r"[^)）\]］】]", ""))
    flags = F.array(
        F.when(F.char_length(s) > LONG, "long"), F.when(s.rlike(SENTENCE), "sentence"), F.when(F.char_length(s) - F.char_length(F.translate(s, ",，", "")) >= 2, "commas"),
        F.when(depth != 0, "brackets"), F.when(no_label, "label"), F.when(s.rlike(SPEC), "measures"),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def trailing_role(s: Column) -> Column:
    """struct(clean, role, hold): a role word behind a separator taken off."""
    match = r"^(.{2,}?)[\s\x{3000}\-－/／\\]+(" + "|".join(sorted(ROLE_WORDS, key=lambda w: (-len(w), w))) + ")$"

    def taken(s: Column, name: Column, word: Column) -> Column:
        hit = (word != "") & (F.char_length(name) >= SHORTEST) & role_of(name).isNull()
        spread = word.isin(*AMBIGUOUS) & name.rlike(r"^\S(?:[\s\x{3000}]+\S)+$")  # a name written with blanks between its characters
        what = F.when(~hit, 0).when(spread, 2).otherwise(1)
        return let(what, lambda w: F.struct(F.when(w == 1, name).otherwise(s).alias("clean"), F.when(w == 1, role_of(word)).alias("role"), F.when(w == 2, "spread").alias("hold")))

    return let(s, lambda s: let(F.regexp_extract(s, match, 2), lambda word: let(F.when(word == "", "").otherwise(trimmed(F.regexp_extract(s, match, 1))), lambda name: taken(s, name, word))))


def name_kind(s: Column, people: Column, fragment: Column | None = None) -> Column:
    """struct(kind, clean, role, hold) of one name.

    ``people`` is how many people the line splits into; ``fragment`` says whether it holds what is left of an HTML
    reference (by default by its form at the end). A name that is held stays as it was written.
    In this order: role_word, fullwidth_semi, needs_resplit, entity, filler, long_text, role_prefix, tail_note, clean.
    """
    return let(trimmed(F.coalesce(s, F.lit(""))), lambda s: _name_kind(s, people, fragment))


def _name_kind(s: Column, people: Column, fragment: Column | None) -> Column:
    def only_roles(whole: Column) -> Column:
        parts = F.filter(F.split(whole, CUTS), lambda p: p != "")
        return F.transform(F.array(parts), lambda ps: (F.size(ps) >= 2) & F.forall(ps, lambda p: role_of(p).isNotNull() | p.isin(*FILLERS)))[0]

    made = lambda kind, clean=s, role=None, hold=None: F.struct(F.lit(kind).alias("kind"), clean.alias("clean"), (F.lit(None).cast("string") if role is None else role).alias("role"), (F.lit(None).cast("string") if hold is None else hold).alias("hold"))
    empty = F.lit("")

    def final(whole: Column, label: Column, word: Column, note: Column) -> Column:
        stripped = label.isNotNull() | word["role"].isNotNull() | note["note"].isNotNull()
        kind = F.when(word["role"].isNotNull() | note["note"].isNotNull() | note["hold"].isNotNull(), "tail_note").when(label.isNotNull(), "role_prefix").otherwise("clean")
        hold = F.when(note["hold"].isNotNull(), note["hold"]).when(stripped & note["clean"].rlike(r"[:：/／\\]"), "structure")
        role = F.coalesce(label["role"], word["role"], note["role"])
        return F.struct(kind.alias("kind"), F.when(hold.isNull(), note["clean"]).otherwise(whole).alias("clean"), F.when(hold.isNull(), role).alias("role"), hold.alias("hold"))

    def notes(whole: Column) -> Column:
        """A label in front, a role word behind a separator and a note at the end taken off; each step is bound, so it runs once."""
        behind = lambda label, word: F.transform(F.array(tail_note(word["clean"])), lambda note: final(whole, label, word, note))[0]
        body = lambda label: F.when(label.isNull(), whole).otherwise(label["rest"])
        named = lambda label: F.transform(F.array(trailing_role(body(label))), lambda word: behind(label, word))[0]
        short = lambda label: label.isNotNull() & (F.char_length(label["rest"]) < SHORTEST)
        return F.transform(F.array(role_prefix(whole)), lambda label: F.when(short(label), made("role_prefix", whole, hold=F.lit("short"))).otherwise(named(label)))[0]

    def judged(whole: Column) -> Column:
        passage = let(long_text_flags(whole), lambda flags: F.when(F.size(flags) > 0, made("long_text", whole, hold=F.array_join(flags, ","))).otherwise(notes(whole)))
        return (
            F.when(only_roles(whole), made("role_word", empty))
            .when(F.regexp_replace(whole, BLANKS, "").isin(*FILLERS), made("filler", empty))
            .when(role_of(whole).isNotNull(), made("role_word", empty, role_of(whole)))
            .otherwise(passage)
        )

    head = lambda tail: trimmed(F.regexp_extract(s, tail, 1))
    cut = let(head(BOOK_TAILS[0]), lambda h: F.when(h != "", h).otherwise(head(BOOK_TAILS[1])))
    broken = s.rlike(REFERENCE) if fragment is None else fragment
    taken = lambda cut, n: F.when((cut != "") & (n["kind"] == "clean") & n["hold"].isNull(), made("tail_note", n["clean"], n["role"])).otherwise(n)
    whole = lambda cut: let(F.when(cut != "", cut).otherwise(s), judged)
    return (
        F.when(s == "", made("clean"))
        .when(only_roles(s), made("role_word", empty))
        .when(F.contains(s, F.lit("；")), made("fullwidth_semi", hold=F.lit("split")))
        .when(people > 1, made("needs_resplit", hold=F.lit("split")))
        .when(broken, made("entity", hold=F.lit("decode")))
        .when(s.rlike(BOOK_ONLY), made("filler", empty))
        .otherwise(let(cut, lambda cut: let(whole(cut), lambda n: taken(cut, n))))
    )


def usual_glyphs(s: Column) -> Column:
    """Every character in its usual writing; for comparing only, never for writing back."""
    return F.translate(s, "".join(VARIANTS.values()), "".join(VARIANTS))
