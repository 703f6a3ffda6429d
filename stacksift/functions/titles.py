"""Promotional words and non-book words in titles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Promotional words that may go, one that never goes alone, what may be left over beside them.
PROMO = "(?:[0-9０-９]+\\s*折|特價|免運費?|瑕疵|優惠|限時)"
KEEP = "限量"
NOISE = "(?:[0-9０-９\\s,，、;；:：\\.。\\-－—~～/＋+]|元|起|新書|預購|商品|品|活動|網路)"
TAIL_PROMO = "(?:[0-9０-９]+\\s*折|特價|優惠|免運費?|限時)"
DANGLING = "(?:[，,、;；:：\\-－—/＋+]|元|價|購|後|路|原)"
OPEN, CLOSE = "（【［(\\[", "）】］)\\]"
SEGMENT = f"[{OPEN}][^{CLOSE}]*[{CLOSE}]"

# Words of goods that are no books; those of the first tier hide a listing, of the second flag it.
NON_BOOK_A = (
    "播放器", "索引貼", "標籤貼", "手鍊", "手鏈", "手環", "胸針", "耳環",
    "杯墊", "抱枕", "薄被", "掛畫", "記事本", "紙偶", "磁鐵",
    "鑰匙圈", "吊飾", "馬克杯", "帆布袋", "T恤", "原子筆", "鋼筆",
    "月曆", "桌曆", "掛曆", "鋯石",
)
NON_BOOK_B = (
    "貼紙", "項鍊", "項鏈", "戒指", "膏油", "筆記本", "玩偶", "布偶", "公仔", "聖餐杯",
    "字卡", "明信片", "賀卡", "卡片", "禱文卡", "禮盒", "套組", "教具", "標籤",
)


def strip_promo(title: Column) -> Column:
    """struct(clean, held): promotional words stripped; where that is not safe the title stays and held is true.

    A bracketed segment goes if promotional words and noise are all it has; a bare word goes from the end if
    what is left is a title. Anything else that holds such a word is left for a person to see.
    """
    has = title.rlike(PROMO)
    segments = F.filter(F.regexp_extract_all(title, F.lit(SEGMENT), F.lit(0)), lambda s: s.rlike(PROMO))
    inner = lambda s: F.substring(s, F.lit(2), F.char_length(s) - 2)
    safe = lambda s: ~F.contains(s, F.lit(KEEP)) & (F.regexp_replace(F.regexp_replace(inner(s), PROMO, ""), NOISE, "") == "")
    unsafe = F.exists(segments, lambda s: ~safe(s))
    cut = F.aggregate(F.filter(segments, safe), title, lambda t, s: F.replace(t, s, F.lit("")))
    tail = f"\\s*{TAIL_PROMO}(?:\\s*[0-9０-９]+\\s*元)?\\s*$"

    def finish(c: Column) -> Column:
        hangs = ~F.contains(c, F.lit(KEEP)) & c.rlike(tail)
        bare = F.trim(F.regexp_replace(c, tail, ""))
        bad_tail = hangs & ((F.char_length(bare) < 4) | bare.rlike(DANGLING + "$"))
        clean = F.trim(F.regexp_replace(F.regexp_replace(F.when(hangs, bare).otherwise(c), "\\s+", " "), f"[{OPEN}]\\s*$", ""))
        untouched = (c == title) & ~hangs
        held = unsafe | bad_tail | untouched | (F.char_length(clean) < 2)
        return F.struct(F.when(held, title).otherwise(clean).alias("clean"), held.alias("held"))

    return F.when(has, F.transform(F.array(cut), finish)[0]).otherwise(F.struct(title.alias("clean"), F.lit(False).alias("held")))


def tier(title: Column, first=NON_BOOK_A, second=NON_BOOK_B) -> Column:
    """struct(tier, word): the first listed word of tier A that the title has, else of tier B, else null."""
    hit = lambda words: F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(title, w)), F.lit(0))
    a, b = hit(first), hit(second)
    return F.when(a.isNotNull(), F.struct(F.lit("A").alias("tier"), a.alias("word"))).when(b.isNotNull(), F.struct(F.lit("B").alias("tier"), b.alias("word")))
