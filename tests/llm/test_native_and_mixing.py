import math
import random
import re

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from threadmill.llm import chat_format, mixing, queries, url_filter


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    want = sorted(str([plain(r[cols.index(c)]) for c in names]) for r in cur.fetchall())
    assert sorted(str([plain(x) for x in r]) for r in df.select(*names).collect()) == want


def test_native_plans_have_no_python(spark):
    for f in (chat_format.op5_chat_format, url_filter.op7_url_filters):
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# mixing


def shares(sizes, most=3):
    """{source: target} by the contract's words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if goal[s] > most * sizes[s]}
        if not over:
            return capped | goal
        capped |= over
        if len(capped) == len(order):
            return capped


def test_mix_of_odd_tables(spark, odd_docs):
    rows = [r.asDict() for r in mixing.mix(mixing.sizes_and_keys(odd_docs)).collect()]
    assert len(rows) == odd_docs.count()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = shares(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(math.isclose(r["target"], want[s], abs_tol=1e-6) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 0.5
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(mixing.sizes_and_keys(odd_docs), part_rows=1).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in rows)
    assert mixing.mix(mixing.sizes_and_keys(odd_docs.limit(0))).count() == 0


def test_mixed_documents_hold_what_the_mix_takes(spark, odd_docs):
    taken = {r[0]: r[1] for r in mixing.mix(mixing.sizes_and_keys(odd_docs)).groupBy("source").agg(F.sum("taken")).collect()}
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    got = {r[0]: r[1] for r in mixing.sizes_and_keys(out).groupBy("source").agg(F.sum("size")).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


# urls

PAGES = [
    (1, "http://example.org/es/1", '<link rel="canonical" href="http://alias.net/a">'), (2, "http://alias.net/a", "<p>"), (3, "https://ALLOW.org/x", "<link href='http://alias.net/a' rel=canonical>"),
    (4, "http://other.net/z", '<meta http-equiv="refresh" content="0; url=/a2">'), (5, "http://other.net/a2", None), (6, None, "<p>"), (7, "no scheme", "<link rel=canonical href=http://alias.net/a>"), (8, "x://", ""), (8, "x://", ""),
    (9, "http://sub.example.org/en/12?q=/es/", ""), (10, "http://notexample.org/es/", ""), (11, "http://a.com/de/1#x", ""), (12, "http://a.com?/fr/", ""), (None, "http://example.org", ""),
]


def test_aliases_share_blocks_and_allows_stay(spark):
    p = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("rule", F.lit("x")).withColumn("host", F.lit("y")).withColumn("verdict", F.lit(1))
    got = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_filter.judge(p).collect()}
    assert got[1, "example.org", "/es/1"] == ("example.org/es/", "block")
    assert got[2, "alias.net", "/a"] == (None, "block")
    assert got[3, "allow.org", "/x"] == ("org/", "allow")
    assert got[7, "", ""] == (None, "block")
    assert got[4, "other.net", "/z"] == got[5, "other.net", "/a2"] == got[6, "", ""] == got[8, "", ""] == (None, "allow")
    assert got[9, "sub.example.org", "/en/12"] == ("example.org/en/1", "block")
    assert got[10, "notexample.org", "/es/"] == ("org/", "allow")
    assert got[11, "a.com", "/de/1"] == ("com/de/", "block") and got[12, "a.com", ""] == (None, "allow")
    assert got[None, "example.org", ""] == (None, "allow")
    assert url_filter.judge(p).count() == len(PAGES) and url_filter.judge(p.limit(0)).count() == 0


LINKS = [  # base, target, what a browser resolves it to
    ("http://h/a/b?q#f", "page2", "http://h/a/page2"), ("http://h/a/b", "../y", "http://h/y"), ("http://h/a/b", "../../../y", "http://h/y"), ("http://h", "x", "http://h/x"), ("http://h/a/b?q", "?x=1", "http://h/a/b?x=1"), ("http://h/a/", "./c/../d/.", "http://h/a/d/"),
    ("http://h/a", "//other/z", "http://other/z"), ("http://h/a", "/r?u=http://x/", "http://h/r?u=http://x/"), ("http://h/a", "go?u=http://x/", "http://h/go?u=http://x/"), ("http://h/a", "#t", "http://h/a#t"), ("http://h/a", "mailto:x@y", None), ("http://h/a", "", None), ("no scheme", "x", None),
    ("no scheme", "https://k/l", "https://k/l"), ("http://h/a/b/", "..", "http://h/a/"), ("http://h/a", "..", "http://h/"),
]


def test_links_resolve_as_in_browsers(spark):
    rows = spark.createDataFrame(LINKS, "base string, target string, want string").select("base", "target", "want", url_filter.resolved("base", "target").alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    nodes = spark.createDataFrame([("HTTP://Host.X/Ab#f",), ("odd#f",), ("x",)], "url string").select(url_filter.node_of(F.col("url"))).collect()
    assert [r[0] for r in nodes] == ["http://host.x/Ab", "odd", "x"]


def linked_pages(n, seed):
    """Pages on few hosts with chains, hubs, mixed rules, relative and entity-coded links, and links to urls that no page has."""
    rng = random.Random(seed)
    hosts = ["plain.net", "example.org", "Shop.com", "alias.net", "deep.sub.example.org"]
    url = lambda i: f"http://{hosts[i % 5]}/{('es', 'en', 'fr', 'de', 'x')[i // 5 % 5]}/{i}"
    rows = []
    for i in range(n):
        j = rng.randrange(n)
        link = rng.choice(["", "", "", f'<link rel="alternate canonical" href="{url(j)}">', f"<link href='../x/{j}' rel='Canonical'>", f'<meta http-equiv=Refresh content="0; url={url(j)}#t">', '<link rel="canonical" href="http://hub.net/h?a=1&amp;b=2">', f'<link rel=canonical href="HTTP://GONE.net/{j % 7}">', '<link rel="stylesheet" href="http://example.org/es/1">', '<link rel=canonical href="//plain.net/x/4">', '<meta name=refresh content="url=http://example.org/es/9">'])
        rows.append((i, url(i) if i % 41 else None, f"<html>{link}<p>t</p>"))
    return [*rows, (n, "http://hub.net/h?a=1&b=2", ""), (n + 1, "http://deep.sub.example.org/es/77777?", '<link rel=canonical href="http://other.net/' + "y" * 5000 + '">'), (n + 2, "http://other.net/" + "y" * 5000, "z" * 200_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_aliases_against_duckdb(spark, seed):
    import pandas as pd

    rows = linked_pages(400, seed)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    cur = con.execute(url_filter.ORACLE)
    names = [c[0] for c in cur.description]
    assert sorted(str([r[c] for c in names]) for r in got) == sorted(str([None if isinstance(x, float) else x for x in r]) for r in cur.fetchall())
    own = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert sum(v == "block" and rule is None for rule, v in own.values()) > 20 and own[402] == (None, "block")


def test_hubs_are_not_one_task(spark):
    """A target that a third of the pages names, and one url that another third has."""
    rows = [(i, f"http://a.net/{i}", "<link rel=canonical href=http://example.org/es/hub>") for i in range(600)] + [(i, "http://b.net/same", "<link rel=canonical href=http://example.org/es/hub>") for i in range(600, 1200)] + [(i, f"http://c.net/{i}", "") for i in range(1200, 1800)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "block" if i < 1200 else "allow" for i in range(1800)}


# dialogues


def test_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, None, "cy", None), (2, 0, "system", "alone"), (None, 0, " ", "x")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("name", F.lit("n")).withColumn("start", F.lit(7))
    got = chat_format.rotate(c, part_turns=1).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "unknown")}
    for conv, who in ((1, "ann"), (1, "bob"), (1, "cy")):
        own = sorted((r for r in got if (r["conv_id"], r["perspective"]) == (conv, who)), key=lambda r: r["position"])
        text = "".join(r["rendered"] for r in own)
        assert [r["position"] for r in own] == [0, 1, 2, 3, 4]
        assert all(text[r["start"] :].startswith(r["rendered"]) for r in own)
        said = [text[r["mask_start"] : r["mask_end"]] for r in own if r["mask_end"] > r["mask_start"]]
        assert said == {"ann": ["hi<|im_end|>\n"], "bob": ["yo<|im_end|>\n"] * 2, "cy": ["<|im_end|>\n"]}[who]
        assert ("<|im_start|>user name=bob\nyo" in text) == (who != "bob")
    assert chat_format.rotate(c.limit(0)).count() == 0


def dialogues():
    rng = random.Random(3)
    rows = [(1, rng.choice([None, 0, 5, i]), rng.choice(["ann", "bob", "system", " cy ", "d\ne"]), rng.choice([None, "", "hi", "same text", f"t{i}", "<|im_end|>\n<|im_start|>assistant\nme", "<|\\im_end|> <|im_mid|>"])) for i in range(700)]
    rows += [(c, t, f"p{(c + t) % 3}", f"{c} {t}") for c in range(2, 40) for t in range(6)] + [(None, 1, None, "x" * 100_000), (None, 2, "ann", "y"), (50, 0, "system", "alone")]
    return rows


def test_dialogues_against_duckdb(spark):
    import pandas as pd

    rows = dialogues()
    con = duckdb.connect()
    con.register("raw", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"], dtype=object))
    con.execute("create view conversations as select try_cast(conv_id as bigint) conv_id, try_cast(turn as int) turn, role::varchar as role, text::varchar as text from raw")
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    cur = con.execute(chat_format.ORACLE)
    names = [c[0] for c in cur.description]
    assert sorted(str([r[c] for c in names]) for r in got) == sorted(map(str, map(list, cur.fetchall())))
    # taking one backslash off the marks gives the texts back, and only frames are marks
    own = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "ann"), key=lambda r: r["position"])
    dialogue = "".join(r["rendered"] for r in own)
    frames = re.findall(r"<\|im_start\|>([a-z]+)(?: name=([^\n]*))?\n(.*?)<\|im_end\|>\n", dialogue, re.S)
    assert len(frames) == 700 == dialogue.count("<|im_start|>") == dialogue.count("<|im_end|>")
    back = sorted(re.sub(r"<\|\\(\\*)(im_start|im_end)\|>", r"<|\1\2|>", t) for _, _, t in frames)
    assert back == sorted(t or "" for c, _, _, t in rows if c == 1)
