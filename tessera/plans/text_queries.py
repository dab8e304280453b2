"""Queries of the text functions and of filters and chunks over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import repetition
from .registry import Tables, query


def words_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({col}, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


def array_sql(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query("t1_tokenize_ident")
def tokenize_ident(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", x.identifier_tokens(F.col("text")).alias("tokens"))


@query("t2_query_terms", f"SELECT conv_id, turn, len(list_distinct(list_filter({words_sql('text')}, lambda w: length(w) > 1 AND NOT list_contains({array_sql(x.FILLER)}, w))))::INT AS terms FROM conversations")
def query_terms(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.size(x.query_terms(F.col("text"))).alias("terms"))


@query("t9_jaccard_words", f"WITH d AS (SELECT doc_id, list_distinct({words_sql('text')}) AS w FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def jaccard_words(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.array_distinct(x.words(F.col("text"))).alias("a"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(nxt, "doc_id").select("doc_id", F.round(x.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("u5_set_sizes", f"SELECT doc_id, len(list_intersect(list_distinct({words_sql('text')}), ['the', 'of', 'and', 'is']))::INT AS shared FROM documents")
def set_sizes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.array_intersect(x.words(F.col("text")), x.literal(["the", "of", "and", "is"]))).alias("shared"))


@query("t10_overlap_ratio", f"SELECT doc_id, round(len(list_intersect(list_distinct({words_sql('text')}), ['the', 'of', 'le', 'und'])) / 4, 6) AS overlap FROM documents")
def overlap_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(F.size(F.array_intersect(x.words(F.col("text")), x.literal(["the", "of", "le", "und"]))) / 4, 6).alias("overlap"))


@query("t12_core_answer", "SELECT conv_id, turn, CASE WHEN contains(trim(text), '. ') THEN split_part(trim(text), '. ', 1) WHEN contains(trim(text), '!') THEN split_part(trim(text), '!', 1) ELSE substring(trim(text), 1, 100) END AS core FROM conversations")
def core_answer(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", x.core_answer(F.col("text")).alias("core"))


@query("t29_extract_topics", "SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN len(list_filter({array_sql(keys)}, lambda k: contains(lower(text), k))) > 0 THEN '{name}' END" for name, keys in x.TOPICS.items()) + "], lambda t: t IS NOT NULL) AS topics FROM conversations")
def extract_topics(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", x.topics(F.col("text")).alias("topics"))


@query("t30_extract_files", "SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(url, '\\b([\\w/]+\\.\\w{1,5})\\b', 1), lambda f: regexp_matches(f, '(?i)\\.(py|js|ts|go|rs|java|yaml|json|toml|md)$'))))::INT AS files FROM pages")
def extract_files(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(x.mentioned_files(F.col("url"))).alias("files"))


@query("t32_extract_entities", "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w, unnest(range(0, len(regexp_split_to_array(text, '[ \\n]+')))) AS i FROM documents WHERE lang = 'en') SELECT w AS entity, count(*) AS mentions FROM w WHERE i > 0 AND regexp_matches(w, '^[A-Z][a-z]{2,}$') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def extract_entities(t: Tables) -> DataFrame:
    """Capitalised words that do not begin a text, with the number of their mentions."""
    w = t.documents.where("lang = 'en'").select(F.posexplode(F.split("text", "[ \n]+")).alias("i", "entity"))
    return w.where((F.col("i") > 0) & F.col("entity").rlike("^[A-Z][a-z]{2,}$")).groupBy("entity").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity").limit(50)


@query("t31_extract_user_facts", r"SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '(?i)my name is (\w+)', 1), ''), nullif(regexp_extract(text, '(?i)call me (\w+)', 1), '')) AS name, coalesce(nullif(regexp_extract(text, '(?i)i work as an? (\w+)', 1), ''), nullif(regexp_extract(text, '(?i)i am an? (\w+)', 1), '')) AS job, nullif(regexp_extract(text, '(?i)i live in (\w+)', 1), '') AS place FROM conversations WHERE role = 'user'")
def extract_user_facts(t: Tables) -> DataFrame:
    first = lambda *patterns: F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in patterns])
    return t.conversations.where("role = 'user'").select("conv_id", "turn", first(r"(?i)my name is (\w+)", r"(?i)call me (\w+)").alias("name"), first(r"(?i)i work as an? (\w+)", r"(?i)i am an? (\w+)").alias("job"), first(r"(?i)i live in (\w+)").alias("place"))


@query("t33_entity_context", "SELECT conv_id, turn, count(*) AS known FROM conversations JOIN nation ON contains(lower(text), lower(n_name)) GROUP BY ALL UNION ALL SELECT -1, -1, count(*) FROM nation")
def entity_context(t: Tables) -> DataFrame:
    n = F.broadcast(t.nation.select("n_name"))  # the dimension has 25 rows
    hit = t.conversations.join(n, F.contains(F.lower("text"), F.lower("n_name"))).groupBy("conv_id", "turn").agg(F.count("*").alias("known"))
    return hit.unionByName(t.nation.agg(F.count("*").alias("known")).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "known"))


@query("t34_extract_claims", "SELECT o_orderkey, w.name, p.name IS NOT NULL AS known FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ring' ELSE 'nothing' || (o_orderkey % 3) END AS name FROM orders) w LEFT JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part) p ON p.name = w.name")
def extract_claims(t: Tables) -> DataFrame:
    """Functions that answers claim, with whether the symbols have them."""
    said = t.orders.select("o_orderkey", F.concat(F.lit("it calls `"), F.when(F.col("o_orderkey") % 3 == 0, "ring").otherwise(F.concat(F.lit("nothing"), F.col("o_orderkey") % 3)), F.lit("()` first")).alias("text"))
    claims = said.select("o_orderkey", F.explode(F.regexp_extract_all("text", F.lit(r"`(\w+)\(\)`"), F.lit(1))).alias("name"))
    known = t.part.select(F.element_at(F.split("p_name", " "), 2).alias("name"), F.lit(True).alias("known")).distinct()
    return claims.join(known, "name", "left").select("o_orderkey", "name", F.coalesce("known", F.lit(False)).alias("known"))


@query("t35_arith_claims", "SELECT o_orderkey, o_orderkey || ' + 2 = ' || (o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 2 END) AS claim, (o_orderkey + 2)::DOUBLE AS value, o_orderkey % 7 <> 0 AS holds FROM orders")
def arith_claims(t: Tables) -> DataFrame:
    s = t.orders.select("o_orderkey", F.concat("o_orderkey", F.lit(" + 2 = "), F.col("o_orderkey") + F.when(F.col("o_orderkey") % 7 == 0, 3).otherwise(2)).alias("text"))
    return s.select("o_orderkey", F.explode(x.arithmetic_claims(F.col("text"))).alias("c")).select("o_orderkey", "c.*")


@query("t36_detect_language", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^\\s*(def |import |class )') THEN 'python' WHEN regexp_matches(text, '\\b(function|const|let)\\b.*[;{]') THEN 'javascript' WHEN regexp_matches(text, '(?i)\\bselect\\b.*\\bfrom\\b') THEN 'sql' ELSE 'text' END AS language FROM documents")
def detect_language(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.language(F.col("text")).alias("language"))


@query("t46_keyword_hash", f"SELECT conv_id, turn, md5(array_to_string({words_sql('text')}, ' ')) AS exact, md5(array_to_string(list_sort(list_distinct(list_filter({words_sql('text')}, lambda w: length(w) > 2 AND NOT list_contains({array_sql(x.STOP)}, w)))), ' ')) AS keywords FROM conversations")
def keyword_hash(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", x.norm_hash(F.col("text")).alias("exact"), x.keyword_hash(F.col("text")).alias("keywords"))


@query("t47_cache_get", f"WITH c AS (SELECT md5(array_to_string({words_sql('text')}, ' ')) AS h, md5(array_to_string(list_sort(list_distinct({words_sql('text')})), ' ')) AS k, conv_id, turn FROM conversations), s AS (SELECT * FROM c WHERE conv_id % 2 = 0), e AS (SELECT h, min(turn) AS a FROM s GROUP BY h), f AS (SELECT k, min(turn) AS b FROM s GROUP BY k) SELECT conv_id, turn, CASE WHEN a IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'keyword' ELSE 'miss' END AS hit, CASE WHEN a IS NOT NULL THEN 1.0 WHEN b IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS factor FROM c LEFT JOIN e USING (h) LEFT JOIN f USING (k)")
def cache_get(t: Tables) -> DataFrame:
    """Answers kept under an exact and a keyword hash; the second is trusted less."""
    w = x.words(F.col("text"))
    c = t.conversations.select("conv_id", "turn", x.norm_hash(F.col("text")).alias("h"), F.md5(F.array_join(F.array_sort(F.array_distinct(w)), " ").cast("binary")).alias("k"))
    s = c.where("conv_id % 2 = 0")
    met = c.join(s.groupBy("h").agg(F.min("turn").alias("a")), "h", "left").join(s.groupBy("k").agg(F.min("turn").alias("b")), "k", "left")
    return met.select("conv_id", "turn", F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "keyword").otherwise("miss").alias("hit"), F.when(F.col("a").isNotNull(), 1.0).when(F.col("b").isNotNull(), 0.9).otherwise(0.0).alias("factor"))


@query("t49_module_candidates", "SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS top FROM pages")
def path_parts(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return t.pages.select("page_id", path.alias("path"), F.substring_index(path, "/", 1).alias("top"))


@query("t50_make_chunk_id", "SELECT doc_id, substring(md5(source || ':' || doc_id || ':' || lang), 1, 16) AS chunk_id FROM documents")
def make_chunk_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring(F.md5(F.concat_ws(":", "source", "doc_id", "lang").cast("binary")), 1, 16).alias("chunk_id"))


@query("u9_path_prefixes", "SELECT page_id, len(string_split(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '.'))::INT AS n FROM pages")
def path_prefixes(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(x.prefixes(x.host(F.col("url")))).alias("n"))


@query("m26_base_url", "WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_replace(url, '/+$', '') AS url FROM pages) SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://' || host || ':11434/v1' WHEN 1 THEN 'http://' || host || ':8080/v1' WHEN 2 THEN 'http://localhost:11434/v1' WHEN 3 THEN 'https://' || host || '/v1/models' ELSE url || CASE WHEN contains(split_part(url, '://', 2), '/v1') THEN '' ELSE '/v1' END END AS base FROM h")
def base_url(t: Tables) -> DataFrame:
    """Bare hosts, hosts with a port, nothing, URLs with a version and without."""
    host = x.host(F.col("url"))
    raw = F.element_at(F.array(F.concat(F.lit(" "), host, F.lit("/ ")), F.concat(host, F.lit(":8080")), F.lit("  "), F.concat(F.lit("https://"), host, F.lit("/v1/models//")), F.col("url")), (F.col("page_id") % 5 + 1).cast("int"))
    return t.pages.select("page_id", x.base_url(raw).alias("base"))


@query("m26_url_normalize", "SELECT page_id, CASE WHEN ends_with(regexp_replace(trim(url), '/+$', ''), '/v1') THEN regexp_replace(trim(url), '/+$', '') ELSE regexp_replace(trim(url), '/+$', '') || '/v1' END AS url FROM pages")
def url_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", x.url_normalize(F.col("url"), "/v1").alias("url"))


@query("m27_is_local_url", "SELECT page_id, regexp_matches(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), '^(localhost|127\\.|10\\.|192\\.168\\.)') AS local, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def is_local_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", x.is_local(F.col("url")).alias("local"), x.slug(F.col("url")).alias("slug"))


@query("m31_normalize_paths", "SELECT page_id, replace(url, '/', '\\') AS windows, replace(replace(url, '/', '\\'), '\\', '/') AS path FROM pages")
def normalize_paths(t: Tables) -> DataFrame:
    w = F.replace("url", F.lit("/"), F.lit("\\"))
    return t.pages.select("page_id", w.alias("windows"), F.replace(w, F.lit("\\"), F.lit("/")).alias("path"))


@query("f14_filter_length", "SELECT doc_id, substring(text, 1, 5000) AS response FROM documents WHERE length(trim(source)) >= 4 AND length(trim(text)) >= 10")
def filter_length(t: Tables) -> DataFrame:
    return t.documents.where((F.length(F.trim("source")) >= 4) & (F.length(F.trim("text")) >= 10)).select("doc_id", F.substring("text", 1, 5000).alias("response"))


@query("f15_filter_abstain", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE (value / 100)::VARCHAR END AS DOUBLE) < 0.5, TRUE) AS abstain FROM events")
def filter_abstain(t: Tables) -> DataFrame:
    c = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise((F.col("value") / 100).cast("string"))
    return t.events.select("event_id", F.coalesce(c.try_cast("double") < 0.5, F.lit(True)).alias("abstain"))


@query("f16_path_filter", "SELECT page_id FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['node_modules', '.git', 'news']) AND NOT ends_with(url, '.pyc')")
def path_filter(t: Tables) -> DataFrame:
    return t.pages.where(~F.arrays_overlap(F.split("url", "/"), x.literal(["node_modules", ".git", "news"])) & ~F.col("url").endswith(".pyc")).select("page_id")


@query("f17_skip_test_paths", "SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), '(^|/)(tests?|examples?)(/|$)|test_|_test\\.')")
def skip_test_paths(t: Tables) -> DataFrame:
    return t.pages.where(~F.lower("url").rlike(r"(^|/)(tests?|examples?)(/|$)|test_|_test\.")).select("page_id")


_RUNS = "w AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w, unnest(range(0, len(string_split(replace(text, chr(10), ' '), ' ')))) AS i FROM documents), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS grp FROM w WHERE w <> '')"


@query("w12_consecutive_runs", f"WITH {_RUNS}, r AS (SELECT doc_id, w, grp, min(i) AS spot, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 4) SELECT doc_id, min(spot) AS first_run FROM r GROUP BY doc_id")
def consecutive_runs(t: Tables) -> DataFrame:
    """Where a word is first said four times on end."""
    w = t.documents.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("i", "w")).where("w <> ''")
    g = w.withColumn("grp", F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "w").orderBy("i")))
    return g.groupBy("doc_id", "w", "grp").agg(F.min("i").alias("at"), F.count("*").alias("n")).where("n >= 4").groupBy("doc_id").agg(F.min("at").cast("long").alias("first_run"))


@query("f19_repetition_truncate")
def repetition_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(x.truncate_repetition(F.col("text"))).alias("kept"), "n_chars")


@query("f19_repetition_patterns", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN repeat('say ' || p_name || ' and then ', 6) || 'stop' WHEN 1 THEN repeat('word' || p_size || ' of it, ', 8) || p_name || chr(10) || chr(10) || '*[Response truncated — repetition detected]*' WHEN 2 THEN repeat('a long way ' || p_size || ' ', 12) || '@' || chr(10) || chr(10) || '*[Response truncated — repetition detected]*' ELSE p_name END AS kept, p_partkey % 4 IN (1, 2) AS cut FROM part")
def repetition_patterns(t: Tables) -> DataFrame:
    """Words that follow themselves, and patterns that the end repeats; plain and short answers stay."""
    many = F.concat(F.repeat(F.concat(F.lit("say "), "p_name", F.lit(" and then ")), 6), F.lit("stop"))
    run = F.concat(F.repeat(F.concat(F.lit("word"), "p_size", F.lit(" of it, ")), 8), "p_name", F.lit(" no no no no no more"))
    pattern = F.concat(F.repeat(F.concat(F.lit("a long way "), "p_size", F.lit(" ")), 12), F.repeat(F.lit("@#=+!"), 100), F.lit("."))
    texts = F.element_at(F.array(many, run, pattern, F.col("p_name")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return repetition.truncated(t.part.select("p_partkey", texts.alias("text")), "p_partkey", "text")


@query("f20_safe_code_filter", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 'rm -rf|DROP TABLE|shutdown') AND regexp_matches(text, '[a-z]+')")
def safe_code_filter(t: Tables) -> DataFrame:
    return t.documents.where(~F.col("text").rlike("rm -rf|DROP TABLE|shutdown") & F.col("text").rlike("[a-z]+")).select("doc_id")


@query("w13_chunk_every_50_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) SELECT doc_id, (i // 50)::BIGINT AS chunk, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY i)) AS content FROM l GROUP BY ALL")
def chunk_every_50_lines(t: Tables) -> DataFrame:
    lines = F.split("text", "\n", -1)
    part = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 50)), lambda k: F.struct(k.cast("long").alias("chunk"), F.slice(lines, (k * 50 + 1).cast("int"), 50).alias("l")))
    return t.documents.select("doc_id", F.explode(part).alias("c")).select("doc_id", "c.chunk", F.size("c.l").cast("long").alias("lines"), F.md5(F.array_join("c.l", "\n").cast("binary")).alias("content"))


@query("w14_def_boundaries", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents), b AS (SELECT * FROM l WHERE regexp_matches(line, '^(The|Der|La|El) ')) SELECT doc_id, i AS line, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS until FROM b")
def def_boundaries(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).where(F.col("s").rlike("^(The|Der|La|El) "))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.lead(F.col("line").cast("long")).over(Window.partitionBy("doc_id").orderBy("line")).alias("until"))


@query("w15_uncovered_ranges", "WITH r AS (SELECT l_orderkey AS f, l_linenumber * 10 AS lo, l_linenumber * 10 + (l_quantity / 5)::INT AS hi FROM lineitem), m AS (SELECT *, max(hi) OVER (PARTITION BY f ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r) SELECT f, upto AS gap_from, lo AS gap_to FROM m WHERE upto < lo")
def uncovered_ranges(t: Tables) -> DataFrame:
    r = t.lineitem.select(F.col("l_orderkey").alias("f"), (F.col("l_linenumber") * 10).alias("lo"), (F.col("l_linenumber") * 10 + F.round(F.col("l_quantity") / 5).cast("int")).alias("hi"))
    upto = F.max("hi").over(Window.partitionBy("f").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    return r.withColumn("upto", upto).where("upto < lo").select("f", F.col("upto").alias("gap_from"), F.col("lo").alias("gap_to"))


@query("m6_get_file", "SELECT coalesce(source, '') || '/' || (doc_id // 50) AS path, count(*) AS chunks, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id)) AS content FROM documents GROUP BY 1")
def get_file(t: Tables) -> DataFrame:
    """A file's chunks, whole and in order; a file has fifty at most here."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 50).cast("string"))
    g = t.documents.groupBy(path.alias("path")).agg(F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("s")))).alias("p"))
    return g.select("path", "chunks", F.md5(F.array_join("p.s", "\n").cast("binary")).alias("content"))


@query("m8_chunk_dispatch", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'ast' WHEN lang IN ('de', 'fr') THEN 'regex' ELSE 'generic' END AS chunker, least(n_chars, 1500) AS size FROM documents WHERE n_chars >= 20")
def chunk_dispatch(t: Tables) -> DataFrame:
    return t.documents.where("n_chars >= 20").select("doc_id", F.when(F.col("lang") == "en", "ast").when(F.col("lang").isin("de", "fr"), "regex").otherwise("generic").alias("chunker"), F.least("n_chars", F.lit(1500)).alias("size"))


@query("m10_snippet", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS snippet FROM documents")
def snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", "\n", -1), 2, 3), "\n").alias("snippet"))


@query("j19_find_references", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) SELECT doc_id, n AS line, CASE WHEN regexp_matches(line, '^The ') THEN 'definition' WHEN regexp_matches(line, 'the,') THEN 'call' ELSE 'reference' END AS kind FROM l WHERE regexp_matches(line, '\\bthe\\b')")
def find_references(t: Tables) -> DataFrame:
    """Lines that hold a word as a whole, by what they do with it; the word test reaches the text before it is cut into lines."""
    lines = t.documents.where(F.contains("text", F.lit("the"))).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s")).where(F.col("s").rlike(r"\bthe\b"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.when(F.col("s").rlike("^The "), "definition").when(F.col("s").rlike("the,"), "call").otherwise("reference").alias("kind"))
