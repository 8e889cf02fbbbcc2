"""Registered queries of chunks, extraction rules, pages, journals and stored vectors, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking
from ..operators import minutes, vector, vector_store
from ..session import shared_folder
from ..sources import html, rules
from .catalog import _FOUND, _asked, _t, query

# --- chunks


@query("SELECT doc_id, sha256(text) AS text_hash, length(text) AS n_chars, true AS fits, true AS ordered FROM documents WHERE length(text) > 0")
def chunked_texts(spark, d):
    """Every text put together again from its chunks, which are none longer than the size and come in order."""
    chunks = chunking.chunk_rows(_t(spark, d, "documents"), "doc_id", "text", strip=False)
    shape = chunks.groupBy("doc_id").agg((F.max(F.length("chunk")) <= 1000).alias("fits"), (F.count_if(F.col("end") - F.col("start") == F.length("chunk")) == F.count(F.lit(1))).alias("ordered"))
    return chunking.rejoined(chunks, "doc_id").join(shape, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("n_chars"), "fits", "ordered")


@query()
def recursive_chunks(spark, d):
    return chunking.chunk_rows(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "place", "start", "end", F.md5("chunk").alias("chunk"))


# --- rules and pages

_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_TAGS = r"sha256(lower(array_to_string(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)(<script\b[^>]*>).*?</script\s*>', '\1', 'g'), '(?is)(<style\b[^>]*>).*?</style\s*>', '\1', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1), '|')))"
_SAVED = f"SELECT {_HOST} AS host, {_TAGS} AS structure, CASE WHEN contains(url, '?') THEN 'p2' ELSE 'p1' END AS prompt, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id AS INT)) AS saved_at, page_id, length(html) AS size FROM pages"
#: Rules of three kinds: a page's title, the links of its menu, and its footer.
_RULES = (
    '{"container": "article", "item": "h1", "fields": {"title": "_text"}}',
    '{"container": "nav", "item": "li > a", "fields": {"title": "_text", "href": "|attr:href"}}',
    '{"item": "footer", "container": "", "fields": {"title": {"method": "constant", "value": "footer"}, "href": {"selector": "a", "method": "attribute", "attribute": "href", "default": "none"}}}',
)
_KEY = ("host",)


def _saved(spark, d):
    """Each page as the layout its host's rules were made for at some time."""
    made = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("page_id").cast("int"))
    kind = F.element_at(F.array(*map(F.lit, _RULES)), (F.length("host") % 3 + 1).cast("int"))
    pages = _t(spark, d, "pages").withColumn("host", F.regexp_extract("url", r"^https?://([^/?#]*)", 1))
    return pages.select("host", html.tag_hash(F.col("html")).alias("structure"), F.when(F.contains("url", F.lit("?")), "p2").otherwise("p1").alias("prompt"), kind.alias("rules"), made.alias("saved_at"), "page_id", "html")


@query(f"""WITH s AS ({_SAVED}), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY saved_at, structure, prompt) AS version FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY version DESC) AS k FROM n WHERE saved_at <= TIMESTAMP '2024-01-05')
SELECT host, CAST(version AS INT) AS version, structure, prompt FROM t WHERE k = 1""")
def rule_versions(spark, d):
    """Versions of each host's rules, written in two goes, and the one that held at a time."""
    saved = _saved(spark, d)
    half = F.lit("2024-01-03").cast("timestamp")
    first = rules.numbered(None, saved.where(F.col("saved_at") < half), _KEY)
    store = first.unionByName(rules.numbered(first, saved, _KEY))
    return rules.current(store, F.lit("2024-01-05").cast("timestamp"), _KEY).select("host", "version", "structure", "prompt")


@query(f"""WITH s AS ({_SAVED}), c AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY saved_at, structure, prompt) AS version, row_number() OVER (PARTITION BY host ORDER BY saved_at DESC, structure DESC, prompt DESC) AS back FROM s WHERE saved_at <= TIMESTAMP '2024-01-06')
SELECT s.page_id, CAST(c.version AS INT) AS version, CASE WHEN c.version IS NULL THEN 'no_rules' WHEN s.structure <> c.structure AND s.prompt <> c.prompt THEN 'both_changed' WHEN s.structure <> c.structure THEN 'structure_changed' WHEN s.prompt <> c.prompt THEN 'prompt_changed' END AS reason,
c.version IS NOT NULL AND s.structure = c.structure AND s.prompt = c.prompt AS reuse FROM s LEFT JOIN c ON s.host = c.host AND c.back = 1""")
def rule_decisions(spark, d):
    """For each page whether the rules its host had at a time can be used again."""
    saved = _saved(spark, d)
    chosen = rules.current(rules.numbered(None, saved, _KEY), F.lit("2024-01-06").cast("timestamp"), _KEY)
    return rules.decided(saved.drop("rules"), chosen, _KEY).select("page_id", "version", "reason", "reuse")


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT page_id, html, {_HOST} AS host FROM pages), v AS (SELECT host, count(*) AS version FROM p GROUP BY 1), l AS (SELECT page_id, host, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS a, unnest(range(len(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')))) AS place FROM p WHERE length(host) % 3 = 1)
SELECT page_id, CAST(version AS INT) AS version, CAST(0 AS BIGINT) AS place, nullif({_PLAIN.format(x="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, '') AS title, NULL AS href FROM p JOIN v USING (host) WHERE length(host) % 3 = 0 AND contains(html, '<h1>')
UNION ALL SELECT page_id, CAST(version AS INT), place, nullif({_PLAIN.format(x="regexp_extract(a, '>([^<]*)</a>', 1)")}, ''), {_PLAIN.format(x="regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} FROM l JOIN v USING (host)
UNION ALL SELECT page_id, CAST(0 AS INT), CAST(0 AS BIGINT), 'footer', 'none' FROM p WHERE length(host) % 3 = 2 AND contains(html, '<footer>')""")
def rule_items(spark, d):
    """Items of every page by the last rules of its host, each host with its own kind; some hosts' rules are given by hand."""
    saved = _saved(spark, d)
    chosen = rules.current(rules.numbered(None, saved, _KEY), None, _KEY)
    static = saved.where(F.length("host") % 3 == 2).select("host", "rules").distinct()
    found = rules.extracted(saved, chosen, static, _KEY, row=["page_id"])
    return found.select("page_id", "version", "place", F.col("fields")["title"].alias("title"), F.col("fields")["href"].alias("href"))


@query(f"""WITH a AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="[^"]*">[^<]*</a></li>') AS l FROM pages WHERE contains(html, '<nav>'))
SELECT page_id, CAST(len(l) AS BIGINT) AS n, array_to_string(list_transform(l, lambda x: {_PLAIN.format(x="regexp_extract(x, 'href=\"([^\"]*)\"', 1)")} || '=' || {_PLAIN.format(x="regexp_extract(x, '>([^<]*)</a>', 1)")}), ' ') AS links FROM a""")
def page_menus(spark, d):
    """The menu of each page as an array of typed objects, after advertisements are removed and lists unwrapped."""
    pages = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    found = html.extract(pages, "body", "nav", {"name": "_text"}, steps=[("remove_elements", ".ad, footer"), ("unwrap_elements", "ul")], children={"links": ("li > a", {"href": "|attr:href", "title": "_text"})})
    shown = F.array_join(F.transform("links", lambda x: F.concat(F.coalesce(x["href"], F.lit("")), F.lit("="), F.coalesce(x["title"], F.lit("")))), " ")
    return found.select(F.col("url").cast("long").alias("page_id"), F.size("links").cast("long").alias("n"), shown.alias("links"))


# --- stored vectors

_STORED = "WITH x AS (SELECT vec_id, label, CASE WHEN label = 5 THEN list_transform(embedding, lambda v: -v) ELSE embedding END AS embedding FROM embeddings WHERE label NOT IN (3, 8))"


@query(f"{_STORED}, y AS (SELECT q.vec_id AS query_id, x.vec_id, x.embedding AS e, q.embedding AS q FROM x JOIN embeddings q ON q.vec_id % 50 = 0), s AS (SELECT query_id, vec_id, {_FOUND[_FOUND.index('round('):_FOUND.index(' AS similarity FROM')]} AS similarity FROM y), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10")
def vector_store_search(spark, d):
    """A stored index after documents were deleted, vectors replaced and all folded once between: every list searched, so the answer is exact."""
    v = _t(spark, d, "embeddings")
    store = vector_store.VectorStore.create(v, shared_folder(spark), lists=20, doc_col="label")
    store.delete(v.where("label = 3").select("label").distinct())
    store.upsert(v.where("label = 5").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.fold()
    store.delete(v.where("label = 8").select("vec_id"))
    return vector_store.VectorStore.open(spark, store.path).search(_asked(v), 10, probes=20)


@query("SELECT vec_id, label FROM embeddings")
def vector_store_rows(spark, d):
    """Every vector is in the store, once, wherever it is listed."""
    v = _t(spark, d, "embeddings")
    store = vector_store.VectorStore.create(v, shared_folder(spark), lists=20, doc_col="label", copies=3)
    return store.rows().select("vec_id", "label")
