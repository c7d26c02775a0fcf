import html
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import common, html_blocks, language, private_data, warc


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.fit(docs.filter(~language.held_out()))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.predictions(docs, model).filter(language.held_out())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    assert model.languages == ("de", "en", "es", "fr") and model.families == ("germanic", "romance")
    assert found.filter("score < 0 or score > 1").count() == 0


def test_held_out_rows_are_those_of_the_checksum(spark, sf):
    for doc_id, held in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", language.held_out()).collect():
        assert held == (zlib.crc32(str(doc_id).encode()) % 3 == 1)


def test_language_of_hard_documents(spark, model):
    docs = brute.hard_documents(spark)
    found = language.predictions(docs, model)
    assert set(docs.columns) <= set(found.columns)
    by_id = {r["doc_id"]: r for r in found.collect() if r["doc_id"] is not None}
    for doc_id in (1, 2, 3, 8):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"]) == ("und", 0.0)
    for doc_id in (4, 6, 7, 9, 10):
        assert by_id[doc_id]["lang_pred"] in model.languages


def test_language_without_anything_to_learn(spark):
    docs = brute.hard_documents(spark, extra=False)
    for empty in (docs.withColumn("lang", F.lit(None).cast("string")), docs.limit(0)):
        nothing = language.fit(empty)
        assert {r[0] for r in language.predictions(docs, nothing).select("lang_pred").collect()} == {"und"}
    assert language.predictions(docs.limit(0), nothing).count() == 0


def test_one_language_and_own_families(spark):
    rows = [(i, f"alpha beta {i}", "qq" if i % 2 else "rr", "s", 1) for i in range(40)]
    one = language.fit(spark.createDataFrame(rows, brute.SCHEMA).filter("lang = 'qq'"))
    assert one.predict("alpha")[0] == "qq" and one.predict("1")[0] == "und"
    two = language.fit(spark.createDataFrame(rows, brute.SCHEMA))
    assert two.families == ("qq", "rr")


def test_learning_uses_no_more_rows_than_stated(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert language.fit(docs, sample_rows=8).languages == ("de", "en", "es", "fr")


def test_copies_take_no_language_from_the_sample(spark):
    few = spark.range(500).select(F.lit("rr").alias("lang"), F.concat(F.lit("alpha beta "), F.col("id")).alias("text"))
    copies = spark.range(500_000).select(F.lit("rr").alias("lang"), F.lit("gamma delta").alias("text"))
    other = spark.range(100).select(F.lit("qq").alias("lang"), F.concat(F.lit("one two "), F.col("id")).alias("text"))
    docs = few.unionByName(copies).unionByName(other)
    found = language.sampled(docs, 20)
    assert {tuple(r) for r in found.groupBy("lang").agg(F.count("*"), F.countDistinct("text")).collect()} == {("qq", 10, 10), ("rr", 10, 10)}
    for lang, rows in (("rr", few.limit(500).unionByName(copies.limit(1))), ("qq", other)):
        marks = sorted(r[0] for r in rows.select(F.xxhash64(F.lit(11), "text")).collect())[:10]
        assert sorted(r["mark"] for r in found.filter(F.col("lang") == lang).collect()) == marks
    assert language.fit(docs, sample_rows=20).languages == ("qq", "rr")


def test_every_language_is_learned_from_if_there_are_more_than_rows(spark):
    docs = spark.range(60).select(F.concat(F.lit("l"), F.col("id") % 6).alias("lang"), F.concat(F.lit("word x"), F.col("id")).alias("text"))
    assert language.fit(docs, sample_rows=4).languages == tuple(f"l{i}" for i in range(6))


def test_base_spans_equal_the_patterns():
    random.seed(1)
    pieces = ["@", ".", "1", "2", "99", "a", "b-", "+", " ", "(", ")", "-", "4111111111111111", "x.y", "256", "%", "é", ","]
    for _ in range(20_000):
        text = "".join(random.choice(pieces) for _ in range(random.randint(1, 25)))
        assert private_data.base_spans(text) == brute.base_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "a@" * 150_000, "1 a " * 20_000):
        private_data.find(text, private_data.Field(np.zeros((5, private_data.FEATURES)), np.zeros((5, 5))))


@pytest.fixture(scope="module")
def field(spark):
    return private_data.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_added_spans_and_clean_texts(field):
    base, spans = private_data.find("call (132) 555-1352 now", field)
    assert base == [] and spans == [(3, 5, 19)]
    for clean in ("on 2024-01-02 at 12:30 there were 17 of them", "version 3.11 has 1,024 rows", "no digits here"):
        assert private_data.find(clean, field) == ([], [])


def test_base_spans_stay(spark, sf, field):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    for row in private_data.private_spans(docs, field).collect():
        base = [(private_data.KINDS.index(s["kind"]), s["start"], s["end"]) for s in row["base"]]
        assert base == brute.base_spans(texts[row["doc_id"]])
        assert set(row["base"]) <= set(row["spans"])


def test_private_data_of_hard_documents(spark, field):
    docs = brute.hard_documents(spark)
    found = {r["doc_id"]: r for r in private_data.private_spans(docs, field).collect()}
    assert [s["kind"] for s in found[9]["base"]] == ["email", "phone"]
    assert found[1]["spans"] == found[2]["spans"] == []
    none = docs.limit(0)
    assert private_data.private_spans(none, private_data.train(none)).count() == 0


def test_best_segmentation_equals_brute_force():
    rng = np.random.default_rng(2)
    field = private_data.Field(rng.normal(size=(5, private_data.FEATURES)), rng.normal(size=(5, 5)))
    text = "12 a@b.c (3) +4567"
    window = private_data.windows(text)[0]
    found, _, scores = private_data._scores(field, text, window)
    place = {f[:2]: c for c, f in enumerate(found)}

    def paths(at, before):
        if at == len(window.words):
            yield 0.0, ()
            return
        for (i, j), c in place.items():
            if i == at:
                for y in range(5):
                    if np.isfinite(scores[c, y]):
                        for value, rest in paths(j, y):
                            yield value + scores[c, y] + field.steps[before, y], ((y, i, j), *rest)

    value, best = max(paths(0, private_data.OTHER))
    spans, steps = private_data.gradient(field, text, window, {(i, j): y for y, i, j in best if y < 4})
    total = np.logaddexp.reduce([v for v, _ in paths(0, private_data.OTHER)])
    # the gradient's sum of expected steps is the difference of two segment counts
    expected = sum(len(p) * np.exp(v - total) for v, p in paths(0, private_data.OTHER))
    assert abs(steps.sum() - (len(best) - expected)) < 1e-6
    shown = [(y, found[place[i, j]][2], found[place[i, j]][3]) for y, i, j in best if y < 4]
    assert set(private_data.best_segments(field, text, window)) <= set(shown)


def test_main_text_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for row in html_blocks.extracted(pages).collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1].replace("<br>", " ")
        blocks = (html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:h1|p)>", article))
        assert row["text"] == "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


PROSE = "The people who were in the house had a lot of things to say about what was in the news and on the radio for the day, so that all of them were glad of it and went to the garden with the dog that was in the house."


def test_main_text_without_an_article():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body>
    <header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies for you</div>
    <div id=content><h2>A heading</h2><p>{PROSE}</p><p>Short &amp; clear.</p><p>{PROSE}</p></div>
    <aside><p>{PROSE}</p></aside><div class="comments"><p>{PROSE}</p></div><form>Name <input></form>
    <p><a href=1>{PROSE}</a></p><script>var x = "<p>{PROSE}</p>";</script><footer>{PROSE}</footer>"""
    assert html_blocks.main_text(page) == "\n".join(["A heading", PROSE, "Short & clear.", PROSE])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("plain &lt;b&gt; text", "plain <b> text"),
        ("<p>one<p>two", "one\ntwo"),
        ("<article><p title='a>b'>kept</p><!-- gone --></article>out", "kept"),
        ("<script>never closed", ""),
        ("<nav><p>menu</p></nav>", ""),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert html_blocks.main_text(page) == text


@pytest.mark.parametrize(
    "before",
    [
        "<select>" + "<option>land" * 200 + "</select>",
        "<select>" + "<option><p>land" * 200 + "</select>",
        "<nav><table>" + "<tr><td>menu" * 100 + "</table></nav>",
        "<nav><dl>" + "<dt>a<dd>b" * 100 + "</dl></nav>",
        "<nav><ul>" + "<li><p>a" * 100 + "</ul></nav>",
        "<nav>" + "<div>" * 200 + "</nav>",
    ],
)
def test_elements_left_open_end_with_what_is_around_them(before):
    assert html_blocks.main_text(f"{before}<article><p>{PROSE}</p></article>") == PROSE
    assert html_blocks.shown_text(html_blocks.parse(f"{before}<p>{PROSE}</p>")).endswith(PROSE)


def test_a_new_sibling_ends_only_those_of_its_own_list_or_table():
    page = "<ul><li class=ad>x<li>one<ul><li class=ad>y</ul>two</ul><table><tr class=ad><td>x<tr><td>three<table><tr class=ad><td>y</table>four</table>"
    shown = html_blocks.parse(page + "<li class=ad><section>z<li>y").blocks
    assert [b.text for b in shown if not b.aside] == ["one", "two", "three", "four"]


def test_both_passes_run_on_pages_with_an_article():
    card = "<article class=card><h3>Card</h3><p>Read on</p></article>"
    page = f"{card}<div><h2>A heading</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div>Imprint</div>"
    assert html_blocks.main_text(page) == "\n".join(["Card", "Read on", "A heading", PROSE, "Short.", PROSE])
    links = "<p><a href=1>one link</a></p><p>More:</p><p><a href=2>another link</a></p>"
    page = f"<article><h1>Title</h1><p>By <a href=b>Author</a></p><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p>{links}</article><p>Imprint</p>"
    assert html_blocks.main_text(page) == "\n".join(["Title", PROSE, "Short.", PROSE])


def test_names_of_articles_are_read():
    page = f"<main class='page with-sidebar'><p>{PROSE}</p><article class='comment odd'><p>Me too. {PROSE}</p></article></main>"
    assert html_blocks.main_text(page) == PROSE


def test_an_article_in_a_language_without_listed_words_stays_whole():
    blocks = ["Tytuł", *("Żółte liście spadają cicho między drzewami, gdy wieczorem wiatr przechodzi przez park miejski." for _ in range(3)), "Koniec."]
    page = "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + f"<p><a href=1>odnośnik</a></p></article><div>{PROSE[:40]}</div>"
    assert html_blocks.main_text(page) == "\n".join([*blocks[:4], "Koniec."])


RUSSIAN = "Вчера вечером в городском парке собрались жители соседних домов, чтобы обсудить новую дорогу, которую начнут строить весной, и все долго спорили о том, нужна ли она городу. Никто не хотел уходить домой, пока не станет ясно, чем всё это закончится."
CHINESE = "昨天晚上附近的居民聚集在城市公园里讨论春天将要开始修建的新道路大家争论了很久到底这座城市需不需要这条路没有人愿意在事情弄清楚之前回家因为所有人都想知道最后的结果会怎么样所以会议一直开到深夜才结束。"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="site has-sidebar"><main><p>{PROSE}</p></main></div>', PROSE),
        (f'<div class="content no-sidebar"><main><p>{PROSE}</p></main></div>', PROSE),
        (f'<div class="ad-free"><article><p>{PROSE}</p></article></div>', PROSE),
        (f'<div class="social-science"><article><p>{PROSE}</p></article></div><p>Imprint</p>', PROSE),
        (f"<form id=aspnetForm><div class=sidebar>More to read</div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></form>", f"Title\n{PROSE}\n{PROSE}"),
        (f"<form id=aspnetForm><nav><a href=1>menu</a></nav><article><p>{PROSE}</p></article></form>", PROSE),
        (f"<a name=top><p>{PROSE}</p><p>{PROSE}</p>", f"{PROSE}\n{PROSE}"),
        (f"<p><a href=#top>Top<p>{PROSE}</p><p>{PROSE}</p>", f"{PROSE}\n{PROSE}"),
        (f"<h1>Новости</h1><p>{RUSSIAN}</p><p>{RUSSIAN}</p><footer>{PROSE}</footer>", f"Новости\n{RUSSIAN}\n{RUSSIAN}"),
        (f"<h1>新闻</h1><p>{CHINESE}</p><p>{CHINESE}</p>", f"新闻\n{CHINESE}\n{CHINESE}"),
        (f'<div class="article-header"><h1>Title</h1></div><article><p>{PROSE}</p></article>', f"Title\n{PROSE}"),
        (f'<div class="article-header"><h1>Title</h1></div><p>{PROSE}</p>', f"Title\n{PROSE}"),
    ],
)
def test_a_wrapper_does_not_hide_the_article(page, text):
    assert html_blocks.main_text(page) == text


@pytest.mark.parametrize(
    "aside",
    [
        f"<div class=sidebar><p>{PROSE}</p><p>{PROSE}</p></div>",
        f"<div class=related><article><p>{PROSE}</p></article></div>",
        f"<div id=comments><article><p>{PROSE}</p></article></div>",
        f"<form><p>{PROSE}</p></form>",
        f"<form><a href=1><div>{PROSE}</div><p>{PROSE}</p></a></form>",
    ],
)
def test_asides_beside_an_article_stay_out(aside):
    text = PROSE.replace("house", "school")
    for page in (f"<article><p>{text}</p></article>{aside}", f"{aside}<p>{text}</p>", f"<div class=ad-free>{aside}<main><p>{text}</p></main></div>"):
        assert html_blocks.main_text(page) == text
    assert html_blocks.main_text(f"<div class=comments><p>{PROSE}</p><article><p>{PROSE}</p></article></div>") == ""


def test_short_blocks_take_the_nearest_label():
    classes = ["good", "short", "short", "short", "bad", "near", "out", "short"]
    assert html_blocks.second_pass(classes, [False] * 8, False) == [True, True, False, False, False, False, False, False]


def test_markup_takes_linear_time():
    for page in ("<" * 200_000, '<a "' * 50_000, "<div>" * 50_000, "</p>" * 50_000, "<p " * 100_000, "<!" * 100_000, "<div class=ad><article>" * 25_000, "<p><a href=x>y" * 50_000):
        html_blocks.main_text(page)


def _pages(spark):
    rows = [(1, "http://a/", "<title>T</title><p>x &amp; y</p><a href='/q'>l</a>"), (2, None, None), (2, None, None), (None, "u\r\nv", "é" * 10)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("clash"))


def test_extraction_of_odd_tables(spark):
    found = html_blocks.extracted(_pages(spark).withColumn("text", F.lit("old")))
    # the short block's only decided neighbour is a block of links
    assert sorted(r["text"] for r in found.collect()) == ["", "", "", "é" * 10]
    assert html_blocks.extracted(_pages(spark).limit(0)).count() == 0


def test_warc_records_link_to_their_source(spark):
    sources = warc.responses(_pages(spark), "2024-01-01T00:00:00Z")
    derived = warc.derivatives(sources)
    folder = common.work_folder(spark, "warc")
    warc.write_warc(derived, folder)
    back = warc.read_warc(spark, folder).collect()
    assert len(back) == 8
    by_id = {r["headers"]["warc-record-id"]: r for r in back}
    known = {r["record_id"]: r for r in sources.collect()}
    for row in back:
        head, block = row["headers"], bytes(row["block"])
        source = known[head["warc-refers-to"]]
        other = by_id[head["warc-derived-with"]]
        assert {row["warc_type"], other["warc_type"]} == {"metadata", "conversion"}
        assert other["headers"]["warc-refers-to"] == head["warc-refers-to"]
        assert head["warc-block-digest"] == warc.digest(block) and int(head["content-length"]) == len(block)
        assert head["warc-source-payload-digest"] == warc.digest(bytes(source["payload"]))
        if row["warc_type"] == "metadata":
            for name, value in source["headers"]:
                assert f"source-header: {name}: {value}\r\n".encode() in block
    first = next(r for r in back if b"title: T\r\n" in bytes(r["block"]))
    assert b"outlink: /q\r\n" in bytes(first["block"])
    assert bytes(by_id[first["headers"]["warc-derived-with"]]["block"]).decode() == "x & y\nl"


def test_warc_records_of_responses_without_an_id(spark):
    rows = [(None, u, "d", None, b"same") for u in ("http://a/", "http://b/")] + [("<urn:x>", "http://a/", "d", None, b"same")]
    derived = warc.derivatives(spark.createDataFrame(rows, warc.RESPONSE)).collect()
    assert len({r["record_id"] for r in derived}) == 6
    for row in derived:
        assert (row["refers_to"] is None) == ("WARC-Refers-To" not in row["head"]) and "None" not in row["head"]


def test_warc_files_are_read_by_many_tasks(spark):
    folder = common.work_folder(spark, "warc")
    rows = [("<urn:%d>" % i, "u", "d", None, b"<p>text") for i in range(40)]
    warc.write_warc(warc.derivatives(spark.createDataFrame(rows, warc.RESPONSE).repartition(8)), folder)
    back = warc.read_warc(spark, folder)
    parts = back.select(F.spark_partition_id().alias("part"), "file").distinct().collect()
    assert len({r["file"] for r in parts}) == 8 and len({r["part"] for r in parts}) > 4
    assert back.count() == 80


def test_warc_of_an_empty_table_and_odd_responses(spark):
    folder = common.work_folder(spark, "warc")
    warc.write_warc(warc.derivatives(warc.responses(_pages(spark).limit(0), "d")), folder)
    assert warc.read_warc(spark, folder).count() == 0
    rows = [(None, None, None, None, None), ("<urn:x>", "u", "d", [("Content-Type", "text/html; charset=latin-1"), (None, None)], b"\xe9\r\n\r\nWARC/1.1\r\n")]
    odd = warc.derivatives(spark.createDataFrame(rows, warc.RESPONSE)).collect()
    assert len(odd) == 4
    assert any(bytes(r["block"]).decode().startswith("é") for r in odd)
