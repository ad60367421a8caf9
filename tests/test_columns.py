from pyspark.sql import functions as F

from threadmill.functions import columns as C
from threadmill.functions import render as R


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_ids_and_references(spark):
    cid = "rg_" + "a" * 24
    assert one(spark, C.is_conversation_id(F.lit(cid + ":x"))) and not one(spark, C.is_conversation_id(F.lit("rg_zz")))
    got = [spark.range(1).select(*C.exchange_ref(F.lit(x))).first() for x in (cid + "#e3", cid + "#e0", cid)]
    assert [tuple(g) for g in got] == [(cid, 2), (None, None), (None, None)]


def test_previews_titles_and_paths(spark):
    assert one(spark, C.preview(F.lit("  a\nb  "))) == "a b"
    assert one(spark, C.preview(F.lit("x" * 201))) == "x" * 200 + "…"
    assert one(spark, C.title_line(F.lit("\n  first line \nsecond"))) == "first line"
    assert one(spark, C.scraped_cwd(F.lit("a <CWD> /x/y </cwd>"))) == "/x/y"
    assert one(spark, C.clean_path(F.lit("/a/./b//../../c/"))) == "/c"


def test_injected_and_visible(spark):
    n = F.lit(None).cast("string")
    no = F.lit(False)
    assert one(spark, C.is_injected(F.lit("  <system-reminder>x")))
    assert one(spark, C.is_visible(F.lit("system"), F.lit("error"), F.lit("x"), n, no)) and not one(spark, C.is_visible(F.lit("system"), F.lit(""), F.lit("x"), n, no))
    assert one(spark, C.is_visible(F.lit("user"), F.lit(""), F.lit(" "), F.lit("other"), no)) and not one(spark, C.is_visible(F.lit("user"), F.lit(""), F.lit(" "), n, no))
    assert not one(spark, C.opens_exchange(F.lit("user"), F.lit("x"), F.lit("task_notification_queued"), no))


def test_rendering(spark):
    assert [one(spark, R.short_count(F.lit(x))) for x in (999, 1234, 3_400_000)] == ["999", "1.2k", "3.4M"]
    assert [one(spark, R.shade(F.lit(x), F.lit(8))) for x in (0, 1, 4, 8)] == [" ", "░", "▒", "█"]
    assert R.cut_text("é" * 3, 3) == "é…" and R.cut_text("ok") == "ok"
    assert R.json_rows(spark.range(1)).first()[0] == '{"id":0}'
