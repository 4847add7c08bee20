"""Queries of the byte-gram engine over the driver's tables, each with its SQL for DuckDB.

`documents` is the corpus (fid = doc_id, content = UTF-8 bytes of text), `pages` the second one. An index
is built once for each table, folder and session and lies in the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.functions.encoding import build_primes, case_variants, gram_key, grams, query_primes, widen
from gramlode.operators.extract import grouped_postings, postings
from gramlode.operators.index import Index, MergedIndex, merge
from gramlode.plans.execute import candidates
from gramlode.plans.rules import parse
from gramlode.plans.verify import scan
from gramlode.sources.samples import from_table, path_list, with_fids
from gramlode.streaming.append import append_batch, open_parts
from gramlode.workers import reachable, shared_folder

TABLES = {"documents": ("doc_id", "text", None), "pages": ("page_id", "html", "url")}
_INDEXES: dict[tuple, Index] = {}

PHRASE = b"thanedble"
WORD = b"licensed"
RARE = b"GNU General"
WIDTH, BUILD_WIDTH, TAU = 11, 8, 200


def samples(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return from_table(reachable(spark).read.parquet(f"{sf_dir}/{table}.parquet"), *TABLES[table])


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def index(spark: SparkSession, sf_dir: str, table: str = "documents") -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _INDEXES:
        rows = samples(spark, sf_dir, table).repartition(spark.sparkContext.defaultParallelism)
        _INDEXES[key] = Index.build(rows, _folder(spark, f"index-{table}"))
    return _INDEXES[key]


# --- extraction and lists


def ngram_extract(spark, sf_dir):
    return postings(samples(spark, sf_dir))


def omit_zero_ngrams(spark, sf_dir):
    wide = samples(spark, sf_dir).select("fid", "path", F.encode(F.regexp_replace(F.decode("content", "UTF-8"), " ", "\u0000"), "UTF-8").alias("content"))
    return postings(wide, omit_zero=True)


def posting_list(spark, sf_dir):
    return index(spark, sf_dir).get_posting_list(PHRASE[:4])


def posting_list_size(spark, sf_dir):
    return index(spark, sf_dir).get_posting_list_size()


def grouped(spark, sf_dir):
    return grouped_postings(index(spark, sf_dir).postings, BUILD_WIDTH)


def fid_to_path(spark, sf_dir):
    pages = index(spark, sf_dir, "pages")
    return pages.fid2path(pages.get_posting_list(WORD[:5]))


# --- lookups


def ngram_conjunctive_match(spark, sf_dir):
    return index(spark, sf_dir).get_posting_list(PHRASE)


def ngram_threshold_match(spark, sf_dir):
    return index(spark, sf_dir).match_posting_lists(PHRASE, 4)


def trigram_match(spark, sf_dir):
    return index(spark, sf_dir).get_posting_list_n3(WORD)


def grouped_match(spark, sf_dir):
    return index(spark, sf_dir).get_posting_list(PHRASE, WIDTH, TAU)


def grouped_match_all(spark, sf_dir):
    return index(spark, sf_dir).get_posting_list(RARE, 11)


def _both(spark, sf_dir) -> MergedIndex:
    return MergedIndex([index(spark, sf_dir), index(spark, sf_dir, "pages")])


def merge_shifted_postings(spark, sf_dir):
    return _both(spark, sf_dir).postings.where(F.col("ngram").isin(sorted(grams(PHRASE))))


def merged_match(spark, sf_dir):
    return _both(spark, sf_dir).get_posting_list(PHRASE)


def merged_fid_to_path(spark, sf_dir):
    """Over a merge that is written."""
    whole = merge([index(spark, sf_dir), index(spark, sf_dir, "pages")], _folder(spark, "merged"))
    return whole.fid2path(whole.get_posting_list(WORD))


def numbered_samples(spark, sf_dir):
    """Ids in the order of the paths."""
    return with_fids(samples(spark, sf_dir).select("path"), "path").select("fid", "path")


def listed_paths(spark, sf_dir):
    """The lines of a text file of URLs, numbered."""
    folder = _folder(spark, "list")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rows.coalesce(1).sortWithinPartitions("page_id").select("url").write.text(folder)  # a path list is one file
    return path_list(spark, folder)


def streamed_index(spark, sf_dir):
    """The paths of a lookup in an index that two micro-batches have made."""
    folder = _folder(spark, "parts")
    for number, name in enumerate(("documents", "pages")):
        append_batch(folder)(samples(spark, sf_dir, name).select("path", "content"), number)
    parts = open_parts(spark, folder, 2)
    return parts.fid2path(parts.get_posting_list(PHRASE))


# --- rules

NOCASE = 'rule r { strings: $a = "Licensed Under" nocase condition: $a }'
WIDE = 'rule r { strings: $a = "thanedble" wide condition: $a }'
HEX = "rule r { strings: $a = { 74 68 61 6E ?? 64 [0-4] 6C 65 20 74 68 } condition: $a }"
REGEX = r"rule r { strings: $a = /Licensed under [A-Z]+ BY-[A-Z]{2}/ condition: $a }"
SOME = 'rule r { strings: $a = "thanedble" $b = "licensed" $c = "@example" $d = "token = " condition: 2 of them }'
AND = 'rule r { strings: $a = "thanedble" $b = "tion" condition: $a and $b }'
OR = 'rule r { strings: $a = "thanedble" $b = "licensed" condition: $a or $b }'
NOT = 'rule r { strings: $a = "thanedble" $b = "licensed" condition: $a and not $b }'
UNIVERSE = 'rule r { strings: $a = "thanedble" condition: not $a }'
SHORT = 'rule r { strings: $a = "BY-" condition: $a }'
CONTAINS = 'rule r { condition: pe.version_info["x"] contains "Licensed" }'
WILDCARD = 'rule r { strings: $a1 = "thanedble" $a2 = "licensed" $b = "token = " condition: any of ($a*) }'
LOOP = 'rule r { strings: $a = "thanedble" condition: for all i in (1..2) : ($a at i) }'
OFFSETS = 'rule r { strings: $a = "thanedble" $b = "tion" condition: @a < @b }'
MACHINE = 'rule r { strings: $a = "thanedble" condition: $a and (pe.machine == pe.MACHINE_I386 or filesize > 3 * 2 + 1) }'
EXPORTS = 'rule r { condition: pe.exports("thanedble") }'
CONSTANT = 'rule r { strings: $a = "thanedble" $b = "ab" condition: ($a and true) or ($a and $b) or false }'
RELAXED = 'rule r { strings: $a = "thanedble" $b = "licensed" $c = "ab" condition: 2 of them }'
EACH = 'rule r { strings: $a = "thanedble" $b = "licensed" condition: $a and for any of them : ($ at 0) }'
GLOBAL = 'global rule g { strings: $x = "licensed" condition: not $x } rule r { strings: $a = "thanedble" condition: $a }'
BATCH = f"""
rule phrase {{ strings: $a = "thanedble" condition: $a }}
rule token {{ strings: $a = /token = "[0-9a-f]{{40}}"/ $b = "@mail" condition: $a or $b }}
rule twice {{ strings: $a = "licensed" condition: #a >= 2 }}
rule large {{ condition: filesize > 20KB }}
rule licence {{ strings: $a = "LICENSED UNDER" nocase fullword $b = {{ 43 43 20 42 59 }} condition: all of them and filesize < 100KB }}
rule start {{ strings: $a = "Erreth was" condition: $a at 0 }}
"""  # fmt: skip


def _candidates(text: str):
    return lambda spark, sf_dir: candidates(index(spark, sf_dir), text).select("fid")


def wide_match(spark, sf_dir):
    """Over samples with a zero byte after each byte."""
    base = samples(spark, sf_dir)
    wide = base.select("fid", "path", F.unhex(F.regexp_replace(F.hex("content"), "(..)", "$100")).alias("content"))
    found = postings(wide).where(F.col("ngram").isin(sorted(grams(widen(PHRASE)))))
    return candidates(Index(found, base.select("fid", "path"), 0), WIDE).select("fid")


def rule_candidates_not(spark, sf_dir):
    return candidates(index(spark, sf_dir), NOT)


def short_string_rule(spark, sf_dir):
    return candidates(index(spark, sf_dir), SHORT, lower_bound=3).select("fid")


def folded_rule(spark, sf_dir):
    return candidates(index(spark, sf_dir), AND.replace('"tion"', '"licensed"'), groupwidth=WIDTH, tau=TAU).select("fid")


def loose_nocase_rule(spark, sf_dir):
    return candidates(index(spark, sf_dir), NOCASE, compat=True).select("fid")


def global_rule(spark, sf_dir):
    return scan(index(spark, sf_dir), samples(spark, sf_dir), GLOBAL)


def rule_universe(spark, sf_dir):
    return candidates(index(spark, sf_dir), UNIVERSE)


def rule_verified_matches(spark, sf_dir):
    return scan(index(spark, sf_dir), samples(spark, sf_dir), NOT)


def batch_rules(spark, sf_dir):
    return scan(index(spark, sf_dir), samples(spark, sf_dir), parse(BATCH))


QUERIES = {
    "ngram_extract": ngram_extract,
    "omit_zero_ngrams": omit_zero_ngrams,
    "posting_list": posting_list,
    "posting_list_size": posting_list_size,
    "ngram_conjunctive_match": ngram_conjunctive_match,
    "ngram_threshold_match": ngram_threshold_match,
    "trigram_match": trigram_match,
    "grouped_postings": grouped,
    "grouped_match": grouped_match,
    "grouped_match_all": grouped_match_all,
    "merge_shifted_postings": merge_shifted_postings,
    "merged_match": merged_match,
    "fid_to_path": fid_to_path,
    "merged_fid_to_path": merged_fid_to_path,
    "numbered_samples": numbered_samples,
    "listed_paths": listed_paths,
    "streamed_index": streamed_index,
    "short_string_rule": short_string_rule,
    "folded_rule": folded_rule,
    "loose_nocase_rule": loose_nocase_rule,
    "global_rule": global_rule,
    "contains_rule": _candidates(CONTAINS),
    "wildcard_set_rule": _candidates(WILDCARD),
    "loop_rule": _candidates(LOOP),
    "offset_rule": _candidates(OFFSETS),
    "machine_rule": _candidates(MACHINE),
    "exports_rule": _candidates(EXPORTS),
    "constant_rule": _candidates(CONSTANT),
    "relaxed_rule": _candidates(RELAXED),
    "each_string_rule": _candidates(EACH),
    "nocase_match": _candidates(NOCASE),
    "wide_match": wide_match,
    "hex_string_match": _candidates(HEX),
    "regex_literal_match": _candidates(REGEX),
    "at_least_n_of": _candidates(SOME),
    "rule_candidates_and": _candidates(AND),
    "rule_candidates_or": _candidates(OR),
    "rule_candidates_not": rule_candidates_not,
    "rule_universe": rule_universe,
    "rule_verified_matches": rule_verified_matches,
    "batch_rules": batch_rules,
}


# --- the same in SQL


def _grams(hexed: str, table: str = "documents", key: str = "doc_id") -> str:
    """g(fid, ng): distinct grams as integers, of a table whose bytes in hex are `hexed`."""
    return f"""d AS (SELECT {key} AS fid, {hexed} AS h FROM {table}),
     e AS (SELECT fid, unnest(regexp_extract_all(h, '..')) AS b, generate_subscripts(regexp_extract_all(h, '..'), 1) AS i FROM d),
     q AS (SELECT fid, b || lead(b, 1) OVER w || lead(b, 2) OVER w || lead(b, 3) OVER w AS x FROM e WINDOW w AS (PARTITION BY fid ORDER BY i)),
     g AS (SELECT DISTINCT fid, ('0x' || x)::UBIGINT::BIGINT AS ng FROM q WHERE x IS NOT NULL)"""


_DOCS = _grams("hex(encode(text))")
_PAGES = _grams("hex(encode(html))", "pages", "page_id")


def _list(keys) -> str:
    return ", ".join(map(str, sorted(keys)))


def _has(text: bytes, out: str = "SELECT fid FROM g") -> str:
    keys = grams(text)
    return f"{out} WHERE ng IN ({_list(keys)}) GROUP BY fid HAVING count(*) = {len(keys)}"


def _any_case(text: bytes) -> str:
    """Every gram position in some spelling."""
    slots = sorted({tuple(sorted(gram_key(v) for v in case_variants(text[i : i + 4]))) for i in range(len(text) - 3)})
    tests = " AND ".join(f"bool_or(ng IN ({_list(s)}))" for s in slots)
    return f"SELECT fid FROM g GROUP BY fid HAVING {tests}"


def _values(primes) -> str:
    return ", ".join(f"({k}, {p})" for k, p in enumerate(primes))


def _grouped_sql(text: bytes, width: int, tau: int | None) -> str:
    """Folded lists: the samples with every remainder, and every gram of the longer lists."""
    keys = grams(text)
    return f"""WITH {_DOCS},
     p(d, p) AS (VALUES {_values(query_primes(width))}),
     k(ng) AS (VALUES {", ".join(f"({x})" for x in sorted(keys))}),
     n AS (SELECT k.ng, count(g.fid) AS n FROM k LEFT JOIN g USING (ng) GROUP BY k.ng),
     small AS (SELECT ng, p FROM n JOIN p ON d = ng % 256 WHERE {"n <= " + str(tau) if tau is not None else "true"}),
     rest AS (SELECT DISTINCT ng, fid % p AS r FROM g JOIN small USING (ng)),
     a AS (SELECT d.fid FROM d JOIN small ON true JOIN rest ON rest.ng = small.ng AND rest.r = d.fid % small.p GROUP BY d.fid HAVING count(*) = (SELECT count(*) FROM small)),
     b AS (SELECT g.fid FROM g JOIN n USING (ng) WHERE ng NOT IN (SELECT ng FROM small) GROUP BY g.fid HAVING count(*) = (SELECT count(*) FROM n) - (SELECT count(*) FROM small))
SELECT fid FROM {"a" if tau is None else "d"} WHERE (fid IN (SELECT fid FROM a) OR (SELECT count(*) FROM small) = 0) AND (fid IN (SELECT fid FROM b) OR (SELECT count(*) FROM small) = (SELECT count(*) FROM n))"""


_BUILD = build_primes(BUILD_WIDTH)
_TEXT = "text"
_TRUE = "CAST(true AS BOOLEAN) AS prunable"

ORACLE_SQL = {
    "ngram_extract": f"WITH {_DOCS} SELECT ng AS ngram, fid FROM g",
    "omit_zero_ngrams": f"WITH {_grams("replace(hex(encode(replace(text, ' ', '_'))), '5F', '00')")} SELECT ng AS ngram, fid FROM g WHERE ng % 256 <> 0 AND (ng // 256) % 256 <> 0 AND (ng // 65536) % 256 <> 0 AND ng // 16777216 <> 0",
    "posting_list": f"WITH {_DOCS} SELECT fid FROM g WHERE ng = {gram_key(PHRASE[:4])}",
    "posting_list_size": f"WITH {_DOCS} SELECT ng AS ngram, count(*) AS n FROM g GROUP BY ng",
    "ngram_conjunctive_match": f"WITH {_DOCS} {_has(PHRASE)}",
    "ngram_threshold_match": f"WITH {_DOCS} SELECT fid FROM g WHERE ng IN ({_list(grams(PHRASE))}) GROUP BY fid HAVING count(*) >= 4",
    "trigram_match": f"WITH {_DOCS} SELECT fid FROM (SELECT DISTINCT fid, ng // 256 AS t FROM g) WHERE t IN ({_list(grams(WORD, 3))}) GROUP BY fid HAVING count(*) = {len(grams(WORD, 3))}",
    "grouped_postings": f"WITH {_DOCS}, p(d, p) AS (VALUES {_values(_BUILD)}) SELECT DISTINCT ng AS ngram, fid % p AS gid FROM g JOIN p ON d = (ng % 256) % {len(_BUILD)}",
    "grouped_match": _grouped_sql(PHRASE, WIDTH, TAU),
    "grouped_match_all": _grouped_sql(RARE, 11, None),
    "merge_shifted_postings": f"SELECT ng AS ngram, fid FROM (WITH {_DOCS} SELECT ng, fid FROM g) WHERE ng IN ({_list(grams(PHRASE))}) UNION ALL SELECT ng AS ngram, fid + (SELECT count(*) FROM documents) AS fid FROM (WITH {_PAGES} SELECT ng, fid FROM g) WHERE ng IN ({_list(grams(PHRASE))})",
    "merged_match": f"SELECT fid FROM (WITH {_DOCS} {_has(PHRASE)}) UNION ALL SELECT fid + (SELECT count(*) FROM documents) AS fid FROM (WITH {_PAGES} {_has(PHRASE)})",
    "fid_to_path": f"WITH {_PAGES}, m AS ({_has(WORD[:5])}) SELECT fid, url AS path FROM m JOIN pages ON page_id = fid",
    "merged_fid_to_path": f"SELECT fid, CAST(fid AS VARCHAR) AS path FROM (WITH {_DOCS} {_has(WORD)}) UNION ALL SELECT fid + (SELECT count(*) FROM documents) AS fid, url AS path FROM (WITH {_PAGES} {_has(WORD)}) JOIN pages ON page_id = fid",
    "numbered_samples": "SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS fid, CAST(doc_id AS VARCHAR) AS path FROM documents",
    "listed_paths": "SELECT row_number() OVER (ORDER BY page_id) - 1 AS fid, url AS path FROM pages",
    "streamed_index": f"""SELECT n AS fid, path FROM (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS n, CAST(doc_id AS VARCHAR) AS path FROM documents) JOIN (WITH {_DOCS} {_has(PHRASE)}) ON fid = doc_id
        UNION ALL SELECT n + (SELECT count(*) FROM documents) AS fid, path FROM (SELECT page_id, row_number() OVER (ORDER BY url) - 1 AS n, url AS path FROM pages) JOIN (WITH {_PAGES} {_has(PHRASE)}) ON fid = page_id""",
    "short_string_rule": f"WITH {_DOCS} SELECT DISTINCT fid FROM g WHERE ng // 256 = {gram_key(b'BY-')}",
    "folded_rule": f"({_grouped_sql(PHRASE, WIDTH, TAU)}) INTERSECT ({_grouped_sql(WORD, WIDTH, TAU)})",
    "loose_nocase_rule": f"WITH {_DOCS} SELECT DISTINCT fid FROM g WHERE ng IN ({_list({gram_key(v) for i in range(11) for v in case_variants(b'Licensed Under'[i : i + 4])})})",
    "global_rule": "SELECT rule, doc_id AS fid, CAST(doc_id AS VARCHAR) AS path FROM documents JOIN (VALUES ('g'), ('r')) AS v(rule) ON rule = 'g' OR contains(text, 'thanedble') WHERE NOT contains(text, 'licensed')",
    "contains_rule": f"WITH {_DOCS} {_any_case(b'Licensed')}",
    "wildcard_set_rule": f"WITH {_DOCS} ({_has(PHRASE)}) UNION ({_has(WORD)})",
    "loop_rule": f"WITH {_DOCS} {_has(PHRASE)}",
    "offset_rule": f"WITH {_DOCS} ({_has(PHRASE)}) INTERSECT ({_has(b'tion')})",
    "machine_rule": f"WITH {_DOCS} {_has(PHRASE)}",
    "exports_rule": f"WITH {_DOCS} {_has(PHRASE)}",
    "constant_rule": f"WITH {_DOCS} {_has(PHRASE)}",
    "relaxed_rule": f"WITH {_DOCS} ({_has(PHRASE)}) UNION ({_has(WORD)})",
    "each_string_rule": f"WITH {_DOCS} {_has(PHRASE)}",
    "nocase_match": f"WITH {_DOCS} {_any_case(b'Licensed Under')}",
    "wide_match": f"WITH {_grams("regexp_replace(hex(encode(text)), '(..)', '\\100', 'g')")} {_has(widen(PHRASE))}",
    "hex_string_match": f"WITH {_DOCS} SELECT fid FROM g WHERE ng IN ({_list(grams(b'than') | grams(b'le th'))}) GROUP BY fid HAVING count(*) = {len(grams(b'than') | grams(b'le th'))}",
    "regex_literal_match": f"WITH {_DOCS} SELECT fid FROM g WHERE ng IN ({_list(grams(b'Licensed under ') | grams(b' BY-'))}) GROUP BY fid HAVING count(*) = {len(grams(b'Licensed under ') | grams(b' BY-'))}",
    "at_least_n_of": f"WITH {_DOCS} SELECT fid FROM ({' UNION ALL '.join(f'({_has(x)})' for x in (PHRASE, WORD, b'@example', b'token = '))}) GROUP BY fid HAVING count(*) >= 2",
    "rule_candidates_and": f"WITH {_DOCS} ({_has(PHRASE)}) INTERSECT ({_has(b'tion')})",
    "rule_candidates_or": f"WITH {_DOCS} ({_has(PHRASE)}) UNION ({_has(WORD)})",
    "rule_candidates_not": f"WITH {_DOCS} SELECT 'r' AS rule, fid, {_TRUE} FROM ({_has(PHRASE)})",
    "rule_universe": "SELECT 'r' AS rule, doc_id AS fid, CAST(false AS BOOLEAN) AS prunable FROM documents",
    "rule_verified_matches": f"SELECT 'r' AS rule, doc_id AS fid, CAST(doc_id AS VARCHAR) AS path FROM documents WHERE contains({_TEXT}, 'thanedble') AND NOT contains({_TEXT}, 'licensed')",
    "batch_rules": """SELECT rule, doc_id AS fid, CAST(doc_id AS VARCHAR) AS path FROM (
        SELECT 'phrase' AS rule, * FROM documents WHERE contains(text, 'thanedble')
        UNION ALL SELECT 'token', * FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"') OR contains(text, '@mail')
        UNION ALL SELECT 'twice', * FROM documents WHERE len(string_split(text, 'licensed')) > 2
        UNION ALL SELECT 'large', * FROM documents WHERE strlen(text) > 20480
        UNION ALL SELECT 'licence', * FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])(?i:licensed under)($|[^A-Za-z0-9_])') AND contains(text, 'CC BY') AND strlen(text) < 102400
        UNION ALL SELECT 'start', * FROM documents WHERE starts_with(text, 'Erreth was'))""",
}
