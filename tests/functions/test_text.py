"""The text functions on cases derived from the rules that they follow."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from kawara.functions import html, text


def cases():
    T = F.col("t")
    return [
        (text.normalize_text(T), "　ＡＢＣ－１２３　ラーメン  ", "ABC-123 ラーメン"),
        (text.normalize_text(T), None, ""),
        (text.normalize_text(T), "a ﻿ b\n", "a b"),
        (text.normalize_name(T), "株式会社 Cafe & Bakery TSUBAME（本店）", "cafe&bakerytsubame"),
        (text.normalize_name(T), "(株)", ""),
        (text.normalize_address(T), "東京都 北区１ー２‐３", "東京都北区1-2-3"),
        (text.normalize_tel(T), "03-1234-5678", "0312345678"),
        (text.normalize_tel(T), "1234", None),
        (text.normalize_tel(T), None, None),
        (text.extract_pref(T), "千葉県から東京都へ", "東京都"),
        (text.extract_pref(T), "北海道", None),
        (text.extract_city(T, F.lit("埼玉県")), "埼玉県さいたま市大宮区桜木町2-1-1", "さいたま市"),
        (text.extract_city(T, F.lit("東京都")), "東京都東村山市本町1", "東村"),
        (text.extract_city(T, F.lit("東京都")), "東京都町田市原町田1", "町田市"),
        (text.extract_city(T, F.lit("東京都")), "東京都羽村市1", "羽村"),
        (text.extract_city(T, F.lit("東京都")), "東京都武蔵村山市1", "武蔵村"),
        (text.extract_city(T, F.lit("東京都")), "千葉県柏市1", None),
        (text.extract_address(T), "住所は東京都北区赤羽１−２２−８ ミヤビル", "東京都北区赤羽1−22−8"),
        (text.extract_address(T, F.lit("東京都")), "場所は渋谷区道玄坂2-10-7です", "東京都渋谷区道玄坂2-10-7"),
        (text.extract_address(T, F.lit("東京都")), "渋谷区道玄坂二丁目", "東京都渋谷区道玄坂二丁目"),
        (text.extract_address(T), "渋谷区道玄坂2-10-7", None),
        (text.extract_address(T), "東京都北区赤羽1-22-8（※公開時点の情報）", "東京都北区赤羽1-22-8"),
        (text.extract_tel(T), "電話：03-1234-5678", "0312345678"),
        (text.extract_tel(T), "☎0466-12-3456", "0466123456"),
        (text.extract_tel(T), "0123-456 電話 03-1234-5678", None),
        (text.extract_tel(T), "０３-1234-5678", None),
        (text.extract_open_date(T, F.lit(2026)), "2026年4月25日にオープン", "2026-04-25"),
        (text.extract_open_date(T, F.lit(2026)), "オープン日：2026/5/1", "2026-05-01"),
        (text.extract_open_date(T, F.lit(2026)), "4月25日オープン", "2026-04-25"),
        (text.extract_open_date(T), "4月25日オープン", None),
        (text.extract_open_date(T, F.lit(2026)), "2019年4月25日オープン", "2026-04-25"),
        (text.extract_open_date(T, F.lit(2026)), "2026年13月45日オープン", "2026-13-45"),
        (text.extract_genre(T), "ダイニングバーとバル", "居酒屋"),
        (text.extract_genre(T), "餃子専門店の餃子", "中華"),
        (text.extract_genre(T), "カクテルと居酒屋", "居酒屋"),
        (text.extract_genre(F.lit(""), T), "中華食堂 ちゃんぽん亭 越谷店", "定食"),
        (text.extract_genre(F.lit(""), T), "餃子酒場 GYOZA HOUSE", "中華"),
        (text.extract_genre(T, T), "やきとん もつ寅", None),
        (text.extract_store_name(T), "【開店】メニューいろいろ！立川駅南口の『ラーメン赤豚』で「旨辛つけ麺」食べてみた", "ラーメン赤豚"),
        (text.extract_store_name(T), "千葉駅から徒歩10分に7/3オープン、KARUKARIで頂くポークビンダルーカレー", "KARUKARI"),
        (text.extract_store_name(T), "2026年4月25日オープン 麺屋さくら", "麺屋さくら"),
        (text.extract_store_name(T), "麺屋さくらが4月25日オープン予定！", "麺屋さくらが"),
        (text.extract_store_name(T), "「新店」麺屋さくら オープン", "「新店」麺屋さくら"),
        (text.extract_store_name(T), "麺屋さくら 新規オープン オープン！ 開店 4月オープン", "麺屋さくら"),
        (text.extract_store_name(T), "オープン", None),
        (text.extract_store_name(T), "「𠮟」食堂", "𠮟"),
        (text.extract_station(T), "メニューいろいろ！立川駅南口", "立川駅"),
        (text.extract_station(T), "東京都千葉駅から", "東京都千葉駅"),
        (text.extract_station(T), "とてもおいしいお店は千葉中央駅", None),
        (text.extract_station(T), "柏駅", None),
        (text.extract_station(T), "大学病院駅、柏駅", None),
        (text.is_food_opening(T, F.lit("")), "令和8年度越谷市省エネ家電買換促進補助金 受付終了のお知らせ", False),
        (text.is_food_opening(T, F.lit("")), "不審者情報", False),
        (text.is_food_opening(T, F.lit("")), "講座「育児期ママのためのマネープラン講座」参加者募集中", False),
        (text.is_food_opening(T, F.lit("")), "【開店】メニューいろいろ！立川駅南口の『ラーメン赤豚』で「旨辛つけ麺」食べてみた", True),
        (text.is_food_opening(T, F.lit("4月に開店した喫茶店")), "葛飾に「喫茶ひなた」", True),
        (text.is_food_opening(T, F.lit("喫茶店")), "葛飾に「喫茶ひなた」", False),
        (text.is_food_opening(T, F.lit("")), "ラーメン一番が閉店、店主の故郷へ移転", False),
        (text.is_food_opening(T, F.lit("")), "ラーメン一番が閉店、隣駅へ移転オープン", True),
        (text.is_food_opening(T, F.lit("")), "美容室が開店、隣はカフェ", False),
        (text.is_food_opening(T, F.lit(None).cast("string")), None, False),
        (text.is_opening_article(T, F.lit("")), "閉店のち開店", True),
        (text.is_opening_article(T, F.lit("")), "閉店", False),
        (text.is_chain(T), "丸亀製麺 駅前店", True),
        (text.is_chain(T), "コ-メダ珈琲", True),
        (text.is_chain(T), "串カツ田中 大和駅前店", True),
        (text.is_chain(T), "MEGUMI食堂", True),
        (text.is_chain(T), "ガストロノミー東京", True),
        (text.is_chain(T), "麺屋さくら", False),
        (text.utf16_length(T), "📞a", 3),
        (html.strip_html(T), "<p>a&nbsp;&amp;<b>b</b><!-- c --></p>\n 1 < 2", "a &b 1 < 2"),
        (html.first_image(T), "<p><img alt='x' data-src=no src='a.png'><img src=b>", "a.png"),
        (html.first_image(T), "<p>none", None),
    ]


def test_cases(spark):
    one, every = spark.range(1), cases()
    for i in range(0, len(every), 20):
        part = every[i : i + 20]
        row = one.select(*[F.lit(t).cast("string").alias(f"t{k}") for k, (_, t, _) in enumerate(part)])
        for k, (column, given, want) in enumerate(part):
            got = row.select(F.col(f"t{k}").alias("t")).select(column.alias("x")).first().x
            assert got == want, (i + k, given, got, want)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><nav>n</nav>short<article>tiny</article></body>", ("shorttiny", None)),
        (f"<head><meta property='og:image' content='og.png'></head><body><img src=out.png><main>{'m' * 201}</main><article>{'a' * 201}<script>x</script><br><div class='ad widget'>w</div></article></body>", ("a" * 201, "og.png")),
        (f"<body><div class='x post-body'>{'p' * 150} {'q' * 150}<img src='in.png'></div></body>", ("p" * 150 + " " + "q" * 150, "in.png")),
        (None, ("", None)),
        ("<body>" + "z" * 20_000, ("z" * 10_000, None)),
        ("<body>a&amp;&amp</h1>b&copy=1 &copyx; &#38; &eacute; & &", ("a&&ampb&copy=1 &copyx; & é & &", None)),
    ],
)
def test_main_content(spark, page, want):
    row = spark.createDataFrame([(page,)], "t string").select(html.main_content(F.col("t")).alias("x")).first().x
    assert tuple(row) == want


def test_dates_are_dates(spark):
    row = spark.createDataFrame([("2026年4月25日オープン",)], "t string").select(F.try_to_date(text.extract_open_date(F.col("t"), F.lit(2026))).alias("d")).first()
    assert row.d == date(2026, 4, 25)


def test_white_space_of_keys(spark):
    """Each white character between the parts of a name, also within brackets, over line ends."""
    white = [chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    rows = spark.createDataFrame([(f"{w}株式会社{w}Ａ（b{w}{w}c）{w}D会社(e",) for w in white] + [("a\nb(c\nd)e",), ("(x)",), ("会社",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(text.normalize_name(F.col("t")), text.normalize_address(F.col("t")), text.normalize_tel(F.concat(F.col("t"), F.lit(" 03－1234　5678")))).collect()]
    assert got[:-4] == [("ad会社(e", "株式会社A（bc）D会社(e", "0312345678")] * len(white)
    assert [g[0] for g in got[-4:]] == ["abe", "", "会社", ""] and [g[1] for g in got[-4:]] == ["ab(cd)e", "(x)", "会社", ""]


def test_any_of_and_white_runs(spark):
    """Words of ASCII and others, found at any place; runs of white characters of any make become one space."""
    t = F.col("t")
    rows = spark.createDataFrame([("xOPEN",), ("x開店y",), ("]a",), ("é open",), (None,), ("a 　b\n c  d\te ",)], "t string")
    got = [tuple(r) for r in rows.select(text.any_of(t, ["OPEN", "開店", "]a"]), text.any_of(t, ["開店"]), text.squeeze(t)).collect()]
    assert got == [(True, False, "xOPEN"), (True, True, "x開店y"), (True, False, "]a"), (False, False, "é open"), (None, None, None), (False, False, "a b c d e")]


def test_long_parts_are_worked_out_once(spark):
    """The normalised text stands once in the plan of an address, not once for each way to find one."""
    plan = spark.range(1).select(text.extract_address(F.col("id").cast("string"), F.lit("東京都")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("場所は") == 1
