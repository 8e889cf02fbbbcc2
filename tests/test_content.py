"""Chunks, pages and their rules, stored vectors, and the text functions beneath, against plain versions."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import chunking, dates, text
from tallyspark.operators import feeds, vector, vector_store
from tallyspark.sources import commits, html, rules

# --- chunks


def split_before(t, separator):
    if separator == "":
        return list(t)
    cuts = [k for k in range(1, len(t)) if t.startswith(separator, k)]
    return [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]


def put_together(parts, size, overlap):
    out, held = [], []
    for p in parts:
        if held and len("".join(held)) + len(p) > size:
            out.append("".join(held))
            while held and (len("".join(held)) > overlap or len("".join(held)) + len(p) > size):
                held.pop(0)
        held.append(p)
    return out + (["".join(held)] if held else [])


def plain_chunks(t, size, overlap, separators):
    """By recursion over whole strings."""
    separator, rest = separators[-1], []
    for k, s in enumerate(separators):
        if s == "" or s in t:
            separator, rest = s, separators[k + 1 :]
            break
    out, good = [], []
    for p in split_before(t, separator):
        if len(p) < size:
            good.append(p)
            continue
        out, good = out + put_together(good, size, overlap), []
        out += plain_chunks(p, size, overlap, rest) if rest else [p]
    return out + put_together(good, size, overlap)


TEXTS = st.text(alphabet="ab \n", max_size=120)


@given(TEXTS, st.integers(2, 30), st.data())
@settings(max_examples=400, deadline=None)
def test_chunks_against_recursion(t, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    found = list(chunking.spans(t, size, overlap))
    assert [t[a:b] for a, b in found] == (plain_chunks(t, size, overlap, ["\n\n", "\n", " ", ""]) if t else [])
    assert all(0 < b - a <= size for a, b in found)
    assert "".join(t[max(a, e) : b] for (a, b), e in zip(found, [0, *(b for _, b in found)])) == t


def test_chunk_rows(spark):
    rng = random.Random(2)
    long = "\n\n".join(" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 400))) for _ in range(12))
    rows = [(1, long), (2, None), (3, ""), (4, " \n "), (5, "x" * 2500), (None, "short "), (6, "日本" * 900)]
    docs = spark.createDataFrame(rows, "id bigint, t string").selectExpr("*", "1 AS place", "2 AS start")
    got = chunking.chunk_rows(docs, "id", "t").collect()
    want = [(i, c.strip()) for i, t in rows if t for c in plain_chunks(t, 1000, 200, ["\n\n", "\n", " ", ""]) if c.strip()]
    assert sorted((str(r.id), r.chunk) for r in got) == sorted((str(i), c) for i, c in want)
    assert all(dict(rows)[r.id][r.start : r.end].strip() == r.chunk for r in got) and {r.place for r in got if r.id == 4} == set()
    again = chunking.rejoined(chunking.chunk_rows(docs, "id", "t", strip=False), "id").collect()
    assert {r.id: r.text for r in again} == {i: t for i, t in rows if t}
    with pytest.raises(ValueError):
        list(chunking.spans("x", 10, 10))


# --- pages

PAGE = """<html><body><div class="list wide" id="top"><table class="m"><tr><td>1</td></tr></table><p>between</p><table class="m"><tbody><tr><td>2</td></tr><tr><td>3 <table><tr><td>in</td></tr></table></td></tr></tbody></table>
<ul><li class="item odd" data-k="a1"><a href="/one?x=1&amp;y=2">One &amp; only</a><span>no. 5</span></li><li class="item"><b>Two</b><span class="v">yes</span><span class="v">no</span><a href='/two'>t</a></li></ul></div><div class="ad">buy <i>now</i></div></body></html>"""


def test_selectors():
    root = html.tree(PAGE)
    of = lambda s: [x.text() for x in html.select(root, s)]
    assert of("li > a") == ["One & only", "t"] and of("ul li.item.odd span") == ["no. 5"] and of("div > li") == [] and of("#top > ul > li:first-child a") == ["One & only"]
    assert of("li:nth-child(2) b, .ad i") == ["Two", "now"] and of("[data-k]") == of("li[data-k^='a']") == of('li[data-k="a1"]') == ["One & only no. 5".replace(" no", "no")]
    assert of("span.v + span") == ["no"] and of("b ~ span") == ["yes", "no"] and of("li:not(.odd) b") == ["Two"] and of("li:last-child a") == ["t"] and of("a[href*='two']") == ["t"] and of("*.ad") == ["buy now"]
    assert of("::bad(") == [] and of("") == [] and of("td:contains('between')") == []


def outline(node):
    return [node.tag, [k if isinstance(k, str) else outline(k) for k in node.kids]]


def test_rewriting():
    removed = html.rewrite(html.tree(PAGE), [("remove_elements", ".ad, table")])
    assert not html.select(removed, "table") and "buy" not in removed.text() and "between" in removed.text()
    unwrapped = html.rewrite(html.tree("<p>a<b>b<i>c</i></b>d<b><b>e</b></b></p>"), [("unwrap_elements", "b")])
    assert outline(unwrapped) == ["", [["p", ["a", "b", ["i", ["c"]], "d", "e"]]]]
    assert all(k.parent is n for n in unwrapped.walk() for k in n.kids if isinstance(k, html.Node))
    merged = html.rewrite(html.tree(PAGE), [("merge_tables", "table.m")])
    assert len(html.select(merged, "table.m")) == 1 and [r.text() for r in html.select(merged, "table.m > tr")] == ["1", "2", "3", "in"]
    assert outline(html.rewrite(html.tree(PAGE), [("other", "p")])) == outline(html.tree(PAGE))


def test_children_and_long_rules(spark):
    pages = spark.createDataFrame([("u", PAGE), ("v", None), ("w", "")], "url string, html string")
    fields = {"name": "a", "own": "li", "raw": {"selector": "b", "method": "html"}, "n": {"pattern": r"no\. (\d+)"}, "fixed": {"method": "constant", "value": "c"}, "none": {"selector": "u", "default": "d"}, "bad": {"pattern": "("}}
    got = html.extract(pages, "div.list", ".item", fields, children={"votes": ("span", {"said": "_text", "kind": "|attr:class"})}).orderBy("place").collect()
    assert [(r.url, r.place, r["name"], r.raw, r.n, r.fixed, r.none, r.bad) for r in got] == [("u", 0, "One & only", None, "5", "c", "d", None), ("u", 1, "t", "Two", None, "c", "d", None)]
    assert [r.own for r in got] == ["One & onlyno. 5", "Twoyesnot"]  # the item itself fits
    assert [[(v.said, v.kind) for v in r.votes] for r in got] == [[("no. 5", None)], [("yes", "v"), ("no", "v")]]


# --- rules as rows


def test_versions_and_decisions(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    new = [("r", "u", "k", "s1", "p1", "{}", at(1)), ("r", "u", "k", "s2", "p1", "{}", at(3)), ("r", None, "k", "s1", "p1", "x", at(2)), ("r", "u", "k", "s1", "p1", "{}", at(1))]
    rows = lambda table: spark.createDataFrame(table, "region string, url string, kind string, structure string, prompt string, rules string, saved_at string").withColumn("saved_at", F.to_timestamp("saved_at"))
    store = rules.numbered(None, rows(new))
    assert sorted((str(r.url), r.version, r.structure) for r in store.collect()) == [("None", 1, "s1"), ("u", 1, "s1"), ("u", 2, "s2")]
    more = rules.numbered(store, rows([*new, ("r", "u", "k", "s3", "p2", "{}", at(5)), ("r", None, "k", "s1", "p1", "y", at(1))]))
    store = store.unionByName(more)
    assert sorted((str(r.url), r.version) for r in store.collect()) == [("None", 1), ("None", 2), ("u", 1), ("u", 2), ("u", 3)]
    now = lambda d: {str(r.url): (r.version, r.structure) for r in rules.current(store, F.to_timestamp(F.lit(at(d)))).collect()}
    assert now(1) == {"u": (1, "s1"), "None": (2, "s1")} and now(4)["u"] == (2, "s2") and now(9)["u"] == (3, "s3")
    seen = spark.createDataFrame([(1, "r", "u", "k", "s3", "p2"), (2, "r", "u", "k", "s3", "p1"), (3, "r", "u", "k", "x", "p2"), (4, "r", "u", "k", None, "p9"), (5, "r", "z", "k", "s3", "p2"), (6, "r", None, "k", "s1", "p1")], "n int, region string, url string, kind string, structure string, prompt string")
    got = {r.n: (r.reuse, r.reason, r.version) for r in rules.decided(seen, rules.current(store)).collect()}
    assert got == {1: (True, None, 3), 2: (False, "prompt_changed", 3), 3: (False, "structure_changed", 3), 4: (False, "both_changed", 3), 5: (False, "no_rules", None), 6: (True, None, 2)}
    runs = spark.createDataFrame([("r", "u", "k", 1, True, 5, at(1)), ("r", "u", "k", 1, True, None, at(3)), ("r", "u", "k", 1, False, 9, at(4)), ("r", "u", "k", 2, None, None, at(4))], "region string, url string, kind string, version int, ok boolean, items int, at string")
    assert sorted((r.version, r.successes, r.failures, r.last_items, r.last_used) for r in rules.outcomes(runs).collect()) == [(1, 2, 1, 5, at(3)), (2, 0, 1, None, None)]


def test_each_page_by_its_own_rules(spark):
    own = '{"item": "li", "fields": {"t": "a"}, "children": {"v": {"selector": "span", "fields": {"s": "_text"}}}}'
    pages = spark.createDataFrame([("a", PAGE), ("b", PAGE), ("c", PAGE), ("d", None), ("e", PAGE)], "url string, html string")
    chosen = spark.createDataFrame([("a", 3, own), ("b", 1, "not json"), ("d", 1, own), ("e", 2, own)], "url string, version int, rules string")
    static = spark.createDataFrame([("e", '{"container": ".ad", "fields": {"t": "_text"}}')], "url string, rules string")
    got = rules.extracted(pages, chosen, static, ["url"]).orderBy("url", "place").collect()
    assert [(r.url, r.version, r.place, r.fields) for r in got] == [("a", 3, 0, {"t": "One & only"}), ("a", 3, 1, {"t": "t"}), ("e", 0, 0, {"t": "buy now"})]
    assert got[1].children == {"v": [{"s": "yes"}, {"s": "no"}]}


# --- vectors


def test_undefined_similarity_comes_last(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, None), (6, [-1.0, 0.0]), (7, [float("inf"), 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(1)
    ask = lambda ids: v.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("query_id"), "embedding")
    assert [(r.vec_id, r.similarity) for r in vector.search(v, ask([1]), 1).collect()] == [(1, 1.0)]
    full = sorted((r["rank"], r.vec_id, r.similarity) for r in vector.search(v, ask([1]), 9).collect())
    assert [(i, s) for _, i, s in full] == [(1, 1.0), (2, 0.993884), (6, -1.0), (3, None), (4, None), (7, None)]
    assert [r.vec_id for r in vector.search(v, ask([3]), 3).orderBy("rank").collect()] == [1, 2, 3]  # nothing is like a vector of no length
    assert [(r.vec_id, r.similarity) for r in vector.top_k(v.where("embedding IS NOT NULL"), [1.0, 0.0], 4).collect()] == [(1, 1.0), (2, 0.993884), (6, -1.0), (3, None)]
    assert vector.search(v, ask([5]), 3).count() == 0


def test_search_against_all(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 5)), 1)
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    asked = v.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 6)
    want = {(q, i) for q in range(0, 300, 7) for i in sorted(range(300), key=lambda i: (-near[q, i], i))[:6]}
    assert {(r.query_id, r.vec_id) for r in vector.search(v, asked, 6).collect()} == want


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors of forty groups, three to a document."""
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(40, 16))
    x = middles[rng.integers(0, 40, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    return x, spark.createDataFrame([(i, i // 3, "t" + str(i), [float(a) for a in r]) for i, r in enumerate(x)], "vec_id bigint, doc_id bigint, note string, embedding array<double>")


def exact(x, ids, asked, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit[asked] @ unit.T, 6)
    return {(q, i) for q, row in zip(asked, near) for i in sorted(ids, key=lambda i: (-row[i], i))[:k]}


def test_store(spark, clustered, tmp_path):
    x, v = clustered
    ask = lambda ids: v.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("query_id"), "embedding")
    store = vector_store.VectorStore.create(v, f"{tmp_path}/s", lists=40)
    asked = list(range(0, 1500, 50))
    found = {(r.query_id, r.vec_id) for r in store.search(ask(asked), 10, probes=4).collect()}
    assert len(found & exact(x, range(1500), asked, 10)) >= 0.9 * 10 * len(asked)  # a tenth of the lists
    assert store.read_share(ask(asked), 4) < 0.2
    plan = store.search(ask([0]), 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*list#", plan)
    # deletions by id and document, replaced vectors, and a second opening
    store.delete(spark.createDataFrame([(0,), (4,), (None,)], "vec_id bigint"))
    store.delete(spark.createDataFrame([(100,)], "doc_id bigint"))
    moved = spark.createDataFrame([(7, 2, "new", [float(a) for a in -x[7]]), (9000, 9, "added", [float(a) for a in x[10]])], v.schema)
    store.upsert(moved)
    store.upsert(spark.createDataFrame([(4, 1, "back", [float(a) for a in x[4]])], v.schema))
    ids = set(range(1500)) - {0, 300, 301, 302} | {9000}
    for s in (store, vector_store.VectorStore.open(spark, f"{tmp_path}/s")):
        rows = {r.vec_id: r.note for r in s.rows().collect()}
        assert set(rows) == ids and rows[7] == "new" and rows[4] == "back" and rows[9000] == "added" and rows[8] == "t8"
    y = np.vstack([x, np.zeros((7501, 16))])
    y[7], y[9000] = -x[7], x[10]
    with np.errstate(all="ignore"):
        want = exact(y, ids, [10, 7, 500], 8)
    asked = v.where(F.col("vec_id").isin([10, 500])).unionByName(moved.where("vec_id = 7")).select(F.col("vec_id").alias("query_id"), "embedding")
    assert {(r.query_id, r.vec_id) for r in store.search(asked, 8, probes=40).collect()} == want
    store.replace_documents(spark.createDataFrame([(9001, 9, "only", [1.0] * 16)], v.schema))
    store.fold()
    after = vector_store.VectorStore.open(spark, f"{tmp_path}/s")
    assert len(after.log) == 1 and {r.vec_id for r in after.rows().collect()} == ids - {27, 28, 29, 9000} | {9001}


def test_store_refuses_a_second_writer(spark, clustered, tmp_path):
    _, v = clustered
    one = vector_store.VectorStore.create(v.limit(50), f"{tmp_path}/s", lists=4, copies=2)
    two = vector_store.VectorStore.open(spark, f"{tmp_path}/s")
    keys = v.limit(1).select("vec_id")
    one.delete(keys)
    with pytest.raises(commits.Conflict):
        two.delete(keys)
    assert vector_store.VectorStore.open(spark, f"{tmp_path}/s").rows().count() == one.rows().count() == 49
    assert one.search(v.limit(3).select(F.col("vec_id").alias("query_id"), "embedding"), 60, probes=4).groupBy("query_id").count().where("count <> 49").count() == 0
    with pytest.raises(ValueError):
        one.delete(v.select("note"))


# --- text functions


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_citations_over_lines(spark):
    said = "Assembly Bill\nNo. 12 and Senate  Bill No. 7; Assembly Bill No.9. SENATE CONCURRENT\nRESOLUTION 3, assembly constitutional amendment no. 4, Assembly bills 5"
    r = one(spark, bills=text.citations(F.lit(said)), spans=text.cited_spans(F.lit("é " + said)))
    assert r.bills == ["AB 12", "SB 7", "AB 9", "SCR 3", "ACA 4"]
    assert [("é " + said)[s.start : s.end].split()[0].lower() for s in r.spans] == ["assembly", "senate", "assembly", "senate", "assembly"] and r.spans[0].end == 22
    assert one(spark, x=text.citations(F.lit(None).cast("string")), y=text.citations(F.lit(""))).asDict() == {"x": None, "y": []}


def test_addresses(spark):
    base = "https://Host.example:443/a/b/page?p=1#x"
    want = {
        "c": "https://host.example/a/b/c", "../d": "https://host.example/a/d", "./../../../e/./f/..": "https://host.example/e/", "/x/../y": "https://host.example/y", "?p=2": "https://host.example/a/b/page?p=2", "#z": "https://host.example/a/b/page?p=1#z",
        "//o.example/q": "https://o.example/q", "HTTP://O.example:80": "http://o.example/", "mailto:a@b": "mailto:a@b", "": "https://host.example/a/b/page?p=1", "..": "https://host.example/a/",
    }
    rows = spark.createDataFrame([(k,) for k in want], "h string").select("h", text.resolve_url(F.lit(base), F.col("h")).alias("u")).collect()
    assert {r.h: r.u for r in rows} == want
    same = {"http://H.example/p?id=1#f": "http://h.example/p?id=1", "http://h.example/p/?id=2": "http://h.example/p?id=2", "http://h.example": "http://h.example/", "http://h.example/": "http://h.example/", "https://h.example/a//": "https://h.example/a/", "ftp://x/": "ftp://x/", "no address/": "no address/"}
    rows = spark.createDataFrame([(k,) for k in same], "h string").select("h", text.canonical_url(F.col("h")).alias("u")).collect()
    assert {r.h: r.u for r in rows} == same
    page = "<A HREF = '/one' >x</a><a class=k href=\" /two?a=1&amp;b=2 \">y</a><a href=\"#f\">z</a><a href='javascript:x()'>j</a><area href='/no'><a\nhref='tel:1'>"
    r = one(spark, plain=text.links(F.lit(page)), whole=text.links(F.lit(page), F.lit("http://h.example/d/")))
    assert r.plain == ["/one", "/two?a=1&b=2"] and r.whole == ["http://h.example/one", "http://h.example/two?a=1&b=2"]


def test_dates_in_texts(spark):
    want = {
        "Feb 17, 2026": "2026-02-17", "Hearing 4/2/24": "2024-04-02", "4/2/2024 10:00": "2024-04-02", "on March 3 2025 at noon": "2025-03-03", "Room 12, 2024": None, "2024-05-06T10:00": "2024-05-06", "13/45/2020": None, "Sept 1, 2020": None, "MAY 5, 2020": "2020-05-05",
        "Room 12, 2024 on 1/2/2023": "2023-01-02", "": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", dates.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in rows} == want


def test_rows_without_a_group_are_in_no_feed(spark):
    rows = spark.createDataFrame([(None, i) for i in range(5)] + [("a", i) for i in range(3)], "g string, u int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert [r.g for r in feeds.threshold_feed(rows, "g", "u", "ts", F.lit("2024-01-01").cast("timestamp")).collect()] == ["a"]


@given(st.lists(st.sampled_from(["4111-1111 1111.1111", "é", "_", "a.b@c.de", "x@", " ", "123-45-6789", "+1 (555) 123-4567", "5551234567", "10.0.0.1", "9", ".", "-", "|", "%a@b.co", "(555)123 4567", "\n", "Z"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_redaction_keeps_its_patterns(t):
    """The quicker forms of the patterns find what the stated ones do."""
    want, got = t, t
    for pattern, shown in text.REDACTIONS:
        shown = re.sub(r"\$(\d)", r"\\\1", shown)
        want = re.sub(pattern, shown, want, flags=re.ASCII)
    for pattern, needed, shown in text.quick_redactions():
        if re.search(needed, got):
            got = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", shown.replace("\\[", "[").replace("\\]", "]")), got)
    assert got == want


def test_bill_keys_and_analyses(spark):
    from tallyspark.functions import bills

    lit = lambda x: F.lit(x).cast("string")
    r = one(
        spark, a=bills.external_id(lit("2023-2024"), lit("AB  12")), b=bills.external_id(lit(None), lit("SB 1")), c=bills.measure_type(lit("acr 12 (amended)")), d=bills.measure_type(lit("12")), e=bills.session_of(lit("https://x/?bill_id=20232024AB1"), F.lit(1999)),
        f=bills.session_of(lit("https://x/?bill_id=20232025AB1&y=20212022"), F.lit(1999)), g=bills.session_of(lit("no"), F.lit(1999)), h=bills.archive_date(lit("/adj022924.pdf"), lit(""), r"adj(\d\d)(\d\d)(\d\d)"), i=bills.archive_date(lit("/adj023024.pdf"), lit("adj010124"), r"adj(\d\d)(\d\d)(\d\d)"), j=bills.archive_date(lit("/x"), lit("adj010124"), r"adj(\d\d)(\d\d)(\d\d)"), k=bills.archive_date(lit("/adj010124"), lit(""), r"adj(\d\d)(\d\d)(\d\d)", "other"),
    )
    assert tuple(map(str, r)) == ("20232024AB12", "SB1", "ACR", "None", "2023-2024", "1999-2000", "1999-2000", "2024-02-29", "None", "2024-01-01", "None")
    said = ['{"topics": ["a", 1, null, {"x": 1}], "whoItAffects": "all"}', '{"skip": true, "topics": ["a"]}', '{"skip": "true", "topics": ["a"]}', '{"topics": [], "whoItAffects": [1]}', '["a"]', "null", "not json", None, '{"skip": false, "whoItAffects": ["w"], "topics": 3}', '"text"']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", bills.rankable(F.col("t")).alias("r")).collect()
    assert {x.i: (x.r.topics, x.r.affects) for x in rows if x.r is not None} == {0: (["a"], []), 2: (["a"], []), 8: ([], ["w"])}
