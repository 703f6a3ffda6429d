"""Expressions and operators on small inputs: must-change and must-not-change lists, edge cases."""

import pytest
from pyspark.sql import functions as F

from stacksift.functions import ids, names, persons, text, titles
from stacksift.operators import components, linkage, search, tables


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_keys(spark):
    assert one(spark, text.loose_key, "路加福音：　A b-C!") == "路加福音abc"
    assert one(spark, text.title_author_key, "", "x") is None
    assert one(spark, text.without_script_tag, "信仰／简") == "信仰"
    assert one(spark, text.volume_tokens, "卷２ 上 12 2 123") == ["12", "2", "上"]


@pytest.mark.parametrize(("a", "b", "want"), [("abcdef", "zabcy", 3), ("", "a", 0), ("same", "same", 4), ("恩典之路", "恩典的路", 2)])
def test_common_substring(spark, a, b, want):
    assert one(spark, text.common_substring, a, b) == want


def test_same_work(spark):
    assert one(spark, text.same_work, "基督徒的信仰／简", "x", "基督徒的信仰", "y")
    assert not one(spark, text.same_work, "真正的快樂", "x", "現代神學精髓", "y")


def test_book_numbers(spark):
    assert one(spark, ids.isbn13, "0-306-40615-2") == "9780306406157"
    assert one(spark, ids.is_isbn10, "080442957X")
    assert not one(spark, ids.is_isbn13, "9780306406158")
    assert one(spark, ids.pick_isbn, "9780306406157", "9791234567896") == "9791234567896"
    assert one(spark, ids.only_isbn, "no. 978-0-306-40615-7 and again 9780306406157") == "9780306406157"
    assert one(spark, ids.resolve_isbn, "9780306406157", "junk").status == "ok"


@pytest.mark.parametrize(("raw", "loose", "strict"), [("2026-7-15", "2026-71", "2026-07-15"), ("2026/07", "2026-07", "2026-07"), ("2026", "2026", "2026"), ("2026-13-01", "2026-13-01", None), ("soon", None, None)])
def test_dates(spark, raw, loose, strict):
    assert one(spark, ids.loose_date, raw) == loose
    assert one(spark, ids.strict_date, raw) == strict


@pytest.mark.parametrize(("title", "clean", "held"), [("路加福音(79折)", "路加福音", False), ("聖經故事 特價", "聖經故事", False), ("書 特價", "書 特價", True), ("恩典【首刷優惠套組】", "恩典【首刷優惠套組】", True), ("限量筆記", "限量筆記", False), ("路加(特價限量)", "路加(特價限量)", True)])
def test_promo(spark, title, clean, held):
    got = one(spark, titles.strip_promo, title)
    assert (got.clean, got.held) == (clean, held)


def test_tiers(spark):
    assert one(spark, titles.tier, "馬克杯貼紙").word == "馬克杯"
    assert one(spark, titles.tier, "十字架的道路") is None


CREDITS = {
    "文、圖:王小明": [("王小明", "author"), ("王小明", "illustrator")],
    "文:江淑文\\圖:陳嘉鈴": [("江淑文", "author"), ("陳嘉鈴", "illustrator")],
    "文／避雨,圖／那羊": [("避雨", "author"), ("那羊", "illustrator")],
    "文:甲乙;圖:丙丁": [("甲乙", "author"), ("丙丁", "illustrator")],
    "巴刻著 趙中輝譯": [("巴刻", "author"), ("趙中輝", "translator")],
    "陸艾文著/高鳳仙譯": [("陸艾文", "author"), ("高鳳仙", "translator")],
    "彭正雄、陳碧凌、創作小組 (彼、桀)": [("彭正雄", None), ("陳碧凌", None), ("創作小組 (彼、桀)", None)],
    "甲乙 (丙丁、戊己": [("甲乙 (丙丁", None), ("戊己", None)],  # brackets do not pair
    "A&#59;B": [("A", None), ("B", None)],
    "A&semi;B": [("A&semi", None), ("B", None)],
    "Anselm Gr&uuml;n": [("Anselm Grün", None)],
    "陳志文": [("陳志文", None)],
    "約珥．薩頓 主編 (Joel Sutton)": [("約珥．薩頓 主編 (Joel Sutton)", None)],
    "李懷光原著/邱瓊苑新編": [("李懷光", "author"), ("邱瓊苑新編", None)],
    "李志秋，張心瑋": [("李志秋", None), ("張心瑋", None)],
    "宮本顯二， 宮本禮子": [("宮本顯二", None), ("宮本禮子", None)],
    "C.S. 路易斯 著，鄧軍海 譯": [("C.S. 路易斯", "author"), ("鄧軍海", "translator")],
    "吳國傑 （Ng， Nathan K. K.）": [("吳國傑 （Ng， Nathan K. K.）", None)],
    "ROBERT J.FUREY，PH.D.": [("ROBERT J.FUREY，PH.D.", None)],
    "Michael Kennedy， S.J.": [("Michael Kennedy， S.J.", None)],
    "Smith, John": [("Smith, John", None)],
    "李四；Jr.": [("李四", None), ("Jr.", None)],
    "Jr.，李四": [("Jr.", None), ("李四", None)],
    "王大明，Smith，Jr.": [("王大明", None), ("Smith，Jr.", None)],
    "王大明，D.Min.": [("王大明，D.Min.", None)],
    "責任編輯：李四；著者：王五": [("李四", "editor"), ("王五", "author")],
    "文/圖": [],
    "梁家麟著 ISBN：9789622083837": [("梁家麟", "author")],
    "": [],
    None: [],
}


def test_credits(spark):
    df = spark.createDataFrame(list(enumerate(CREDITS)), "line long, credit string")
    got = {}
    for r in names.people(df, "line", "credit").orderBy("line", "place").collect():
        got.setdefault(r["line"], []).append((r["name"], r["role"]))
    want = {i: w for i, w in enumerate(CREDITS.values()) if w}
    assert got == want


KINDS = {
    "文:王小明": ("role_prefix", "王小明", "author"), "文、圖:王小明": ("role_prefix", "王小明", "author"), "文/圖:王小明": ("role_prefix", "王小明", "author"), "文/懶鬼KK": ("role_prefix", "懶鬼KK", "author"),
    "經文引用:和合本修訂版聖經": ("long_text", "經文引用:和合本修訂版聖經", None), "文子梁": ("clean", "文子梁", None), "圖/賽卓．卡利耶羅 編文/道格．莫斯": ("role_prefix", "圖/賽卓．卡利耶羅 編文/道格．莫斯", None),
    "亨利.克勞德/約翰.湯森德": ("clean", "亨利.克勞德/約翰.湯森德", None), "文：甲": ("role_prefix", "文：甲", None), "李著": ("tail_note", "李著", None), "著者": ("role_word", "", "author"),
    "ISBN 9789626735206": ("filler", "", None), "978-986-400-168-2": ("filler", "", None), "王小明 出版：校園": ("tail_note", "王小明", None), "台灣教會公報社出版": ("clean", "台灣教會公報社出版", None),
    "陳恩明 ISBN ： 9789888562442 出版：突破": ("tail_note", "陳恩明", None), "林治平主編著": ("tail_note", "林治平", "author"), "馮 煒 文": ("clean", "馮 煒 文", None), "雷日昇 攝影": ("tail_note", "雷日昇", "illustrator"),
    "甲；乙": ("fullwidth_semi", "甲；乙", None), "Anselm Gr&uuml": ("entity", "Anselm Gr&uuml", None),
}


def test_kinds_of_names(spark):
    df = spark.createDataFrame([(s,) for s in KINDS], "s string")
    got = {r["s"]: (r["k"]["kind"], r["k"]["clean"], r["k"]["role"]) for r in df.select("s", persons.name_kind(F.col("s"), F.lit(1)).alias("k")).collect()}
    assert got == KINDS


def test_references_left_in_names():
    assert [names.has_reference(s) for s in ("Gr&uuml", "A&#59", "CLOUD&TOWNSEND", "Tony&Tina", "&semi;")] == [True, True, False, False, True]


def test_judge(spark):
    df = spark.createDataFrame([("賴特", "湯姆．賴特", ["a"], ["b"]), ("", None, ["a"], ["b"]), ("賴特", "李四", ["a"], ["b"]), ("賴特", "賴特 等", ["a"], ["a"])], "a string, b string, x array<string>, y array<string>")
    assert [r[0] for r in df.select(names.judge(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).collect()] == ["merge", "review", "keep", "review"]


def test_components_and_aliases(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    al = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (5, 3)], "k long, t long")
    assert dict(linkage.flatten_aliases(al, "k", "t").collect()) == {1: None, 2: 1, 3: 1, 4: None, 5: 1}
    assert components.connected_components(e.where("false")).count() == 0


def test_page_past_the_end(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    assert [(r["k"], r["total"]) for r in search.page_with_total(df, [F.col("k")], 2, 5).collect()] == [(5, 7), (6, 7)]
    assert search.page_with_total(df, [F.col("k")], 9, 5).count() == 0


def test_exclusive_split(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    a, b = tables.split_exclusively(df, F.col("x") > 1)
    assert (a.count(), b.count()) == (1, 2)
