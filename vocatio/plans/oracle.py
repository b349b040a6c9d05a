"""DuckDB SQL for the registered queries, written apart from the DataFrame code.

Where the engine rewrites a plan (either-or joins, array membership, ranges of names), the SQL
here keeps the plain form.
"""

from __future__ import annotations

#: Parts of queries by name, each with what it needs.
_CTE = {
    "postings": (
        [],
        """SELECT o_orderkey AS job_posting_raw_id, o_orderkey // 10 AS scrape_run_id, o_orderkey AS job_id,
 'https://jobs.example.com/view/' || lower(replace(p_brand, '#', '-')) || '-' || o_orderkey || '?position=' || (o_orderkey % 25) || '&pageNum=0&refId=x' AS source_url,
 CASE o_orderkey % 3 WHEN 1 THEN '  ' || upper(replace(p_brand, '#', '   ')) WHEN 2 THEN lower(replace(p_brand, '#', ' ')) || ' ' ELSE replace(p_brand, '#', ' ') END AS title_raw,
 c_name AS company_raw, CASE WHEN o_orderkey % 97 = 0 THEN '   ' ELSE n_name END AS location_raw,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Director' WHEN '2-HIGH' THEN 'Senior level' WHEN '3-MEDIUM' THEN 'Mid Level' WHEN '5-LOW' THEN 'Entry level' WHEN '4-NOT SPECIFIED' THEN 'Not Applicable' END AS seniority_level_raw,
 o_orderstatus AS employment_type_raw, CASE WHEN c_mktsegment = 'MACHINERY' THEN '  ' ELSE c_mktsegment END AS industry_raw, o_orderdate AS scraped_at
 FROM orders LEFT JOIN (SELECT l_orderkey, p_brand FROM (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey) f JOIN part ON p_partkey = pk) t ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "title_map": ([], "SELECT lower(replace(p_brand, '#', ' ')) AS key_normalized, CASE WHEN n = 23 THEN 'unknown' ELSE 'role ' || (n % 5) END AS value_normalized, 'llm' AS method FROM (SELECT DISTINCT p_brand, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS n FROM part) WHERE n < 24"),
    "location_map": ([], "SELECT lower(n_name) AS key_normalized, CASE WHEN n = 23 THEN 'unknown' ELSE 'area ' || (n % 8) END AS value_normalized, 'fuzzy' AS method FROM (SELECT DISTINCT n_name, CAST(replace(n_name, 'NATION_', '') AS INTEGER) AS n FROM nation) WHERE n <> 24"),
    "seniority_map": ([], "SELECT * FROM (VALUES (false, 'director', 'executive'), (false, 'senior level', 'senior'), (false, 'mid level', 'mid'), (false, 'entry level', 'junior')) v(use_title_key, source_key, value_normalized) UNION ALL SELECT true, lower(replace(p_brand, '#', ' ')), CASE WHEN n % 2 = 0 THEN 'mid' ELSE 'not_applicable' END FROM (SELECT DISTINCT p_brand, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS n FROM part) WHERE n % 3 <> 0"),
    "cleaned": (["postings"], r"SELECT *, trim(regexp_replace(lower(coalesce(title_raw, '')), '\s+', ' ', 'g')) AS tk, trim(regexp_replace(lower(coalesce(location_raw, '')), '\s+', ' ', 'g')) AS lk, trim(regexp_replace(lower(coalesce(seniority_level_raw, '')), '\s+', ' ', 'g')) AS sk FROM postings"),
    "keys": (["cleaned"], "SELECT * FROM cleaned WHERE tk <> '' AND lk <> '' AND sk <> ''"),
    "ready": (
        ["keys", "title_map", "location_map", "seniority_map"],
        """SELECT scrape_run_id, job_posting_raw_id FROM keys WHERE tk IN (SELECT key_normalized FROM title_map) AND lk IN (SELECT key_normalized FROM location_map)
 AND EXISTS (SELECT 1 FROM seniority_map m WHERE (sk = 'not applicable' AND m.use_title_key AND m.source_key = tk) OR (sk <> 'not applicable' AND NOT m.use_title_key AND m.source_key = sk))""",
    ),
    "stg": (
        ["cleaned", "ready", "title_map", "location_map", "seniority_map"],
        """SELECT c.*, t.value_normalized AS title_normalized, l.value_normalized AS location_normalized, s.value_normalized AS seniority_normalized
 FROM cleaned c JOIN ready r USING (scrape_run_id, job_posting_raw_id) LEFT JOIN title_map t ON t.key_normalized = tk LEFT JOIN location_map l ON l.key_normalized = lk
 LEFT JOIN seniority_map s ON (sk = 'not applicable' AND s.use_title_key AND s.source_key = tk) OR (sk <> 'not applicable' AND NOT s.use_title_key AND s.source_key = sk)""",
    ),
    "stg_old": (["stg"], "SELECT * FROM stg WHERE scraped_at < TIMESTAMP '1996-01-01'"),
    "skills": ([], "SELECT DISTINCT l_orderkey AS job_posting_raw_id, p_name AS skill_name FROM lineitem JOIN part ON p_partkey = l_partkey"),
    "dim_skills": ([], r"SELECT row_number() OVER (ORDER BY skill_name) AS skill_id, skill_name FROM (SELECT DISTINCT trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS skill_name FROM part)"),
    "bridge": (["skills", "dim_skills"], "SELECT DISTINCT job_posting_raw_id, skill_id FROM skills JOIN dim_skills d ON d.skill_name = lower(skills.skill_name)"),
    "runs": (["postings"], "SELECT scrape_run_id, CASE WHEN scrape_run_id % 7 = 3 THEN 'failed' ELSE 'successful' END AS status FROM (SELECT DISTINCT scrape_run_id FROM postings UNION SELECT -1)"),
    "ledger": ([], "SELECT * FROM (VALUES (1, [0, 1, 2], 'successful', 'skill_extraction'), (2, [4, 5], 'failed', 'dbt'), (3, [6, 8, 9], 'successful', 'skill_extraction'), (4, [11], 'running', 'normalization')) v(normalization_process_run_id, scrape_run_ids, status, stage)"),
    "unresolved": (
        ["keys", "title_map", "location_map", "seniority_map"],
        """SELECT DISTINCT 'title' AS domain, CAST(NULL AS BOOLEAN) AS use_title_key, tk AS key FROM keys WHERE tk NOT IN (SELECT key_normalized FROM title_map)
 UNION ALL SELECT DISTINCT 'location', CAST(NULL AS BOOLEAN), lk FROM keys WHERE lk NOT IN (SELECT key_normalized FROM location_map)
 UNION ALL SELECT DISTINCT 'seniority', sk = 'not applicable', CASE WHEN sk = 'not applicable' THEN tk ELSE sk END FROM keys
 WHERE NOT EXISTS (SELECT 1 FROM seniority_map m WHERE NOT m.use_title_key AND m.source_key = sk) AND NOT EXISTS (SELECT 1 FROM seniority_map m WHERE m.use_title_key AND m.source_key = tk)""",
    ),
}
_DIM = {
    "titles": ("title", "title_normalized", "nullif(trim(title_normalized), '') IS NOT NULL AND lower(trim(title_normalized)) <> 'unknown'"),
    "locations": ("location", "location_normalized", "nullif(trim(location_normalized), '') IS NOT NULL AND lower(trim(location_normalized)) <> 'unknown'"),
    "companies": ("company", "company_raw", r"nullif(regexp_replace(trim(coalesce(company_raw, '')), '\s+', ' ', 'g'), '') IS NOT NULL"),
}
for _name, (_x, _col, _ok) in _DIM.items():
    for _suffix, _stg in (("", "stg"), ("_old", "stg_old")):
        _CTE[f"dim_{_name}{_suffix}"] = ([_stg], f"SELECT row_number() OVER (ORDER BY {_x}_name) AS {_x}_id, {_x}_name FROM (SELECT DISTINCT {_col} AS {_x}_name FROM {_stg} WHERE {_ok})")
    _CTE[f"dim_{_name}_next"] = (
        ["stg", f"dim_{_name}_old"],
        f"SELECT * FROM dim_{_name}_old UNION ALL SELECT (SELECT coalesce(max({_x}_id), 0) FROM dim_{_name}_old) + row_number() OVER (ORDER BY {_x}_name), {_x}_name FROM (SELECT DISTINCT {_col} AS {_x}_name FROM stg WHERE {_ok}) n WHERE NOT EXISTS (SELECT 1 FROM dim_{_name}_old o WHERE o.{_x}_name = n.{_x}_name)",
    )


def _fact(stg: str, suffix: str) -> tuple[list[str], str]:
    return (
        [stg, f"dim_titles{suffix}", f"dim_companies{suffix}", f"dim_locations{suffix}"],
        f"""SELECT scrape_run_id, job_posting_raw_id, job_id, title_id, company_id, location_id, title_raw AS title, title_normalized, company_raw AS company, location_normalized AS location,
 seniority_normalized AS seniority, employment_type_raw AS employment_type, industry_raw AS industry, CAST(NULL AS VARCHAR) AS description, source_url, scraped_at
 FROM {stg} JOIN dim_titles{suffix} ON title_name = title_normalized JOIN dim_companies{suffix} ON company_name = company_raw JOIN dim_locations{suffix} ON location_name = location_normalized
 WHERE coalesce(title_normalized, '') NOT IN ('', 'unknown') AND coalesce(location_normalized, '') NOT IN ('', 'unknown') AND coalesce(seniority_normalized, '') NOT IN ('', 'unknown')""",
    )


_CTE["fact"] = _fact("stg", "")
_CTE["fact_old"] = _fact("stg_old", "_old")
_CTE["fact_next"] = _fact("stg", "_next")
_CTE["refused"] = ([], "SELECT min(o_orderkey) AS refused FROM orders WHERE o_orderkey >= (SELECT max(o_orderkey) * 3 / 4 FROM orders) AND (o_orderkey // 10) % 11 <> 5 AND o_orderkey % 5 <> 0")
_CTE["collected"] = (["refused"], "SELECT *, o_orderkey // 10 AS run, (o_orderkey // 10) % 11 <> 5 AS found, (o_orderkey // 10) % 11 <> 5 AND o_orderkey % 5 <> 0 AND o_orderkey % 13 <> 4 AND o_orderkey < coalesce(refused, 9223372036854775807) AS taken FROM orders, refused")
_CTE["names"] = ([], "SELECT c_name AS key, 'role ' || lower(c_name) AS value, (row_number() OVER (ORDER BY c_name) - 1) // 3 AS batch FROM (SELECT DISTINCT c_name FROM customer)")
_CTE["first_time"] = (["names"], "SELECT *, bool_or(key LIKE '%77') OVER (PARTITION BY batch) AS bad, CASE WHEN bool_or(key LIKE '%13') OVER (PARTITION BY batch) THEN 2 ELSE 1 END AS attempts FROM names")
_CTE["asked_first"] = (["first_time"], "SELECT key, CASE WHEN NOT bad THEN value END AS value, CASE WHEN bad THEN 'unavailable' END AS error, CASE WHEN bad THEN 1 ELSE attempts END AS attempts FROM first_time WHERE batch // 2000 <= coalesce((SELECT min(batch // 2000) FROM first_time WHERE bad), 9223372036854775807)")
_CTE["left_over"] = (["names", "asked_first"], "SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // 3 AS batch FROM names WHERE key NOT IN (SELECT key FROM asked_first WHERE value IS NOT NULL)")
_CTE["claimable"] = (["runs", "postings"], "SELECT scrape_run_id, row_number() OVER (ORDER BY scrape_run_id) AS rn FROM runs WHERE status = 'successful' AND scrape_run_id IN (SELECT scrape_run_id FROM postings)")
_CTE["asked"] = (["fact", "bridge", "dim_skills"], "SELECT f.*, skill_name FROM fact f JOIN bridge USING (job_posting_raw_id) JOIN dim_skills USING (skill_id)")


def sql(body: str, *needs: str) -> str:
    """The query with the parts it needs in front, in order."""
    seen: dict[str, str] = {}

    def visit(name: str) -> None:
        if name not in seen:
            for n in _CTE[name][0]:
                visit(n)
            seen[name] = _CTE[name][1]

    for n in needs:
        visit(n)
    return ("WITH " + ",\n".join(f"{n} AS ({q})" for n, q in seen.items()) + "\n" if seen else "") + body


_REACH = "count(*) AS job_posting_count, count(DISTINCT company_id) AS company_count"
_LABELS = "'director', 'Mid-Senior level', 'Associate', 'Team Lead', 'Manager', 'Internship', 'TBD', 'Level II', 'Level III'"


def _ladder(key: str, raw: bool) -> str:
    has = lambda words: f"regexp_matches({key}, '(^|[^a-z])({words})([^a-z]|$)')"
    steps = [
        ("director|executive|vp|vice president|c-level|founder|owner|head|chief|ceo|cto|cfo|coo", "executive"), ("lead|team lead|principal|staff" + ("|manager" if raw else ""), "lead"), ("senior|sr|experienced|iii|iv", "senior"),
        ("mid|mid-level|intermediate|ii", "mid"), ("junior|jr|entry|entry-level|associate|early career", "junior"), ("intern|internship|trainee|student", "intern"),
    ]
    out = " ".join(f"WHEN {has(w)} THEN '{v}'" for w, v in steps)
    if raw:
        return f"CASE {out} ELSE 'unknown' END"
    years = f"TRY_CAST(regexp_extract({key}, '([0-9]+)[ ]*\\+?[ ]*(yrs?|years?)', 1) AS BIGINT)"
    junk = has("open|open to work|looking for|seeking|opportunit(y|ies)|various|multiple positions|submit your resume|tbd|not specified|n/a")
    return f"CASE {out} WHEN {years} >= 6 THEN 'senior' WHEN {years} >= 3 THEN 'mid' WHEN {years} >= 0 THEN 'junior' WHEN {key} = '' OR {junk} THEN 'unknown' ELSE 'not_applicable' END"


QUERIES = {
    "ingest_runs": sql(
        """SELECT run AS scrape_run_id, CASE WHEN NOT any_value(found) OR run >= any_value(refused) // 10 THEN 'failed' ELSE 'successful' END AS status, count(*) FILTER (found) AS jobs_seen_count, count(*) FILTER (taken) AS jobs_inserted_count,
 CASE WHEN NOT any_value(found) THEN 'search failed' WHEN run >= any_value(refused) // 10 THEN 'blocked: 429' END AS error_message FROM collected GROUP BY run""",
        "collected",
    ),
    "ingest_postings": sql(
        """SELECT run AS scrape_run_id, o_orderkey AS job_id, 'https://jobs.example.com/view/job-' || o_orderkey || '?position=1&pageNum=0' AS source_url, o_orderpriority AS title_raw, 'Company ' || o_custkey AS company_raw, o_orderstatus AS location_raw, o_orderpriority AS seniority_level_raw,
 'Ordered' || chr(10) || strftime(o_orderdate, '%Y-%m-%d') AS description_raw FROM collected WHERE taken UNION ALL SELECT NULL, o_orderkey, NULL, 'stored', NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0""",
        "collected",
    ),
    "resolver_outcomes": sql("SELECT 'title' AS domain, key, value, error, attempts FROM asked_first UNION ALL SELECT 'title', key, value, NULL, CASE WHEN bool_or(key LIKE '%13') OVER (PARTITION BY batch) THEN 2 ELSE 1 END FROM left_over", "asked_first", "left_over"),
    "skills_by_vocabulary": """WITH RECURSIVE book AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', 1), lower(p_type), CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) || ' ' || p_name END]) AS phrase FROM part),
 t AS (SELECT l_orderkey AS id, string_split(string_agg(p_name || ' ' || lower(p_type), ' ' ORDER BY l_linenumber, p_partkey), ' ') AS w FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
 g AS (SELECT id, unnest(range(1, len(w) + 1)) AS pos, w FROM t),
 c AS (SELECT id, pos, n, array_to_string(w[pos : pos + n - 1], ' ') AS phrase FROM g, (SELECT unnest([1, 2, 3]) AS n) WHERE pos + n - 1 <= len(w)),
 b AS (SELECT id, pos, max(n) AS n, max_by(phrase, n) AS phrase FROM c WHERE phrase IN (SELECT phrase FROM book WHERE phrase IS NOT NULL) GROUP BY id, pos),
 s AS (SELECT g.id, g.pos, b.n, b.phrase FROM g LEFT JOIN b ON b.id = g.id AND b.pos = g.pos),
 r AS (SELECT * FROM s WHERE pos = 1 UNION ALL SELECT s.* FROM r JOIN s ON s.id = r.id AND s.pos = r.pos + coalesce(r.n, 1)),
 f AS (SELECT id, phrase, min(pos) AS pos, row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS rn FROM r WHERE phrase IS NOT NULL GROUP BY id, phrase)
 SELECT id AS l_orderkey, string_agg(phrase, ';' ORDER BY pos) AS skills FROM f WHERE rn <= 10 GROUP BY id""",
    "candidate_skill_overlap": sql("SELECT o.o_custkey AS candidate, b.job_posting_raw_id, count(*) AS matched FROM bridge b JOIN (SELECT DISTINCT o_custkey, skill_id FROM orders JOIN bridge ON job_posting_raw_id = o_orderkey WHERE o_custkey % 100 = 0) o USING (skill_id) GROUP BY 1, 2", "bridge"),
    "parse_search_cards": "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS job_id, p_name AS title, p_type AS company, 'Town' AS location, 'https://jobs.example.com/view/' || replace(p_name, ' ', '-') || '-' || p_partkey || '?position=1&pageNum=0' AS source_url FROM part",
    "parse_job_post": "SELECT p_partkey, p_name AS title, p_type AS company, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS posted, CAST(NULL AS VARCHAR) AS applicants, 'Line' || chr(10) || 'two' AS sections, 'Mid level' AS seniority_level FROM part",
    "claimed_runs": sql("SELECT 1 AS normalization_process_run_id, 'failed' AS status, scrape_run_id FROM claimable WHERE rn <= 3 UNION ALL SELECT 1 + (rn + 2) // 3, 'running', scrape_run_id FROM claimable WHERE rn <= 6", "claimable"),
    "published_orders": """WITH bad AS (SELECT 'unknown priority' AS "check" FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' UNION ALL SELECT 'no lines' FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) UNION ALL SELECT 'repeated' FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
 SELECT "check", count(*) AS n FROM bad GROUP BY 1 UNION ALL SELECT 'published', count(*) FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "gold_top_skills": sql(f"SELECT skill_name, {_REACH}, count(DISTINCT title_id) AS title_count, count(DISTINCT location_id) AS location_count FROM asked GROUP BY skill_name", "asked"),
    "gold_skills_by_role": sql(f"SELECT title_normalized, seniority, skill_name, {_REACH} FROM asked GROUP BY ALL", "asked"),
    "gold_top_skills_by_industry": sql(
        f"""SELECT industry, skill_rank, skill_name, job_posting_count, company_count, title_count, location_count FROM (
 SELECT *, dense_rank() OVER (PARTITION BY industry ORDER BY job_posting_count DESC, skill_name) AS skill_rank FROM (
 SELECT coalesce(nullif(trim(industry), ''), 'Unknown') AS industry, skill_name, {_REACH}, count(DISTINCT title_id) AS title_count, count(DISTINCT location_id) AS location_count FROM asked GROUP BY 1, 2)) WHERE skill_rank <= 20""",
        "asked",
    ),
    "gold_company_hiring_demand": sql("SELECT company, count(*) AS job_posting_count, count(DISTINCT title_id) AS distinct_roles, count(DISTINCT location_id) AS distinct_locations, count(DISTINCT seniority) AS distinct_seniority_levels, min(scraped_at) AS first_seen_at, max(scraped_at) AS last_seen_at FROM fact GROUP BY company", "fact"),
    "gold_location_demand": sql(f"SELECT location, {_REACH}, count(DISTINCT title_id) AS title_count FROM fact GROUP BY location", "fact"),
    "gold_job_market_summary": sql(f"SELECT title_normalized, location, seniority, employment_type, industry, {_REACH}, min(scraped_at) AS first_seen_at, max(scraped_at) AS last_seen_at FROM fact GROUP BY 1, 2, 3, 4, 5", "fact"),
    "stg_job_postings": sql("SELECT scrape_run_id, job_posting_raw_id, job_id, title_raw, company_raw, location_raw, source_url, scraped_at, seniority_level_raw, employment_type_raw, CAST(NULL AS VARCHAR) AS job_function_raw, industry_raw, CAST(NULL AS VARCHAR) AS description_raw, title_normalized, location_normalized, seniority_normalized FROM stg", "stg"),
    **{f"dim_{n}": sql(f"SELECT * FROM dim_{n}", f"dim_{n}") for n in _DIM},
    **{f"dim_{n}_incremental": sql(f"SELECT * FROM dim_{n}_next", f"dim_{n}_next") for n in _DIM},
    "fact_job_postings": sql("SELECT * FROM fact", "fact"),
    "fact_job_postings_incremental": sql("SELECT * FROM fact_old UNION ALL SELECT * FROM fact_next n WHERE NOT EXISTS (SELECT 1 FROM fact_old o WHERE o.scrape_run_id = n.scrape_run_id AND o.job_posting_raw_id = n.job_posting_raw_id)", "fact_old", "fact_next"),
    "staging_ready": sql("SELECT DISTINCT scrape_run_id, job_posting_raw_id FROM postings WHERE job_posting_raw_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)", "postings"),
    "staging_upsert": sql("SELECT scrape_run_id, job_posting_raw_id, CASE WHEN scraped_at >= TIMESTAMP '1996-01-01' THEN 'new' ELSE 'old' END AS load FROM (SELECT scrape_run_id, job_posting_raw_id, scraped_at FROM ready JOIN postings USING (scrape_run_id, job_posting_raw_id))", "ready", "postings"),
    "clean_keys": sql("SELECT job_posting_raw_id, tk AS title_key, lk AS location_key, sk AS seniority_key FROM keys", "keys"),
    "clean_keys_sql_variant": sql(r"SELECT DISTINCT title_raw, regexp_replace(lower(trim(coalesce(title_raw, ''))), '\s+', ' ', 'g') AS title_key FROM postings", "postings"),
    "parse_semicolon": sql("SELECT p_partkey, list_filter(list_transform(string_split(' ' || replace(p_name, ' ', ' ; ') || ';;' || p_type, ';'), lambda x: trim(x)), lambda x: x <> '') AS items FROM part"),
    "clean_seniority": sql("SELECT o_orderkey, CASE WHEN v IN ('intern', 'junior', 'mid', 'senior', 'lead', 'executive', 'not_applicable', 'unknown') THEN v ELSE 'unknown' END AS label FROM (SELECT o_orderkey, replace(lower(trim(CASE o_orderpriority WHEN '1-URGENT' THEN ' Executive' WHEN '2-HIGH' THEN 'SENIOR ' WHEN '3-MEDIUM' THEN 'Not Applicable' ELSE o_orderpriority END)), ' ', '_') AS v FROM orders)"),
    "distinct_skills": sql("SELECT l_orderkey, count(*) AS n, min(s) AS first_skill FROM (SELECT DISTINCT l_orderkey, lower(p_type) AS s FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY l_orderkey"),
    "token_sort": sql("SELECT DISTINCT p_name, list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ' ') AS sorted FROM part"),
    "job_id_from_url": sql(r"SELECT job_posting_raw_id, source_url, coalesce(nullif(regexp_extract(source_url, '-(\d+)\?position', 1), ''), nullif(regexp_extract(source_url, '-(\d+)', 1), '')) AS url_job_id FROM postings", "postings"),
    "clean_url": sql(r"SELECT job_posting_raw_id, regexp_replace(source_url, '&refId=x', '') AS url FROM postings", "postings"),
    "unresolved_keys": sql("SELECT * FROM unresolved", "unresolved"),
    "unresolved_keys_strict": sql("SELECT DISTINCT sk = 'not applicable' AS use_title_key, CASE WHEN sk = 'not applicable' THEN tk ELSE sk END AS key FROM keys WHERE NOT EXISTS (SELECT 1 FROM seniority_map m WHERE (sk = 'not applicable' AND m.use_title_key AND m.source_key = tk) OR (sk <> 'not applicable' AND NOT m.use_title_key AND m.source_key = sk))", "keys", "seniority_map"),
    "readiness": sql("SELECT * FROM ready", "ready"),
    "normalization_summary": sql(
        """SELECT total, ready, ut AS unresolved_title, ul AS unresolved_location, us AS unresolved_seniority, greatest(nt - ut, 0) + greatest(nl - ul, 0) + greatest(ns - us, 0) AS resolved_by_map FROM
 (SELECT count(*) AS total, count(DISTINCT tk) AS nt, count(DISTINCT lk) AS nl, count(DISTINCT CASE WHEN sk = 'not applicable' THEN 't:' || tk ELSE 's:' || sk END) AS ns FROM keys), (SELECT count(*) AS ready FROM ready),
 (SELECT count(*) FILTER (domain = 'title') AS ut, count(*) FILTER (domain = 'location') AS ul, count(*) FILTER (domain = 'seniority') AS us FROM unresolved)""",
        "unresolved", "ready",
    ),
    "candidates": sql("SELECT p.scrape_run_id, p.job_posting_raw_id FROM postings p WHERE p.scrape_run_id IN (SELECT scrape_run_id FROM runs WHERE status = 'successful') AND NOT EXISTS (SELECT 1 FROM ready r WHERE r.scrape_run_id = p.scrape_run_id AND r.job_posting_raw_id = p.job_posting_raw_id)", "postings", "runs", "ready"),
    "seniority_from_raw": sql(f"SELECT v, {_ladder('lower(v)', True)} AS level FROM (SELECT DISTINCT seniority_level_raw AS v FROM postings UNION SELECT unnest([{_LABELS}]))", "postings"),
    "seniority_from_title": sql(f"SELECT p_partkey, title, {_ladder('lower(title)', False)} AS level FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_name || ' ' || p_size || ' years' WHEN 1 THEN 'Senior ' || p_name WHEN 2 THEN p_name || ' II' WHEN 3 THEN 'Chief of ' || p_name WHEN 4 THEN 'Various ' || p_name ELSE p_name END AS title FROM part)"),
    "skills_extract": sql(r"SELECT doc_id, len(s) AS n_skills FROM (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}+#]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w IN ('the', 'trash', 'clown', 'le', 'de', 'der', 'und', 'with', 'edst', 'for'))) AS s FROM documents)"),
    "dim_skills_upsert": sql("SELECT * FROM dim_skills", "dim_skills"),
    "skills_bridge_upsert": sql("SELECT * FROM bridge", "bridge"),
    "unprocessed_descriptions": sql("SELECT doc_id AS job_posting_raw_id, text AS description FROM documents WHERE trim(text) <> '' AND doc_id IN (SELECT o_orderkey FROM orders) AND doc_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)"),
    "runs_to_process": sql("SELECT scrape_run_id FROM runs r WHERE status = 'successful' AND EXISTS (SELECT 1 FROM postings p WHERE p.scrape_run_id = r.scrape_run_id) AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.status = 'successful' AND list_contains(l.scrape_run_ids, r.scrape_run_id))", "runs", "ledger"),
    "unextracted_ready": sql("SELECT DISTINCT job_posting_raw_id FROM ready r WHERE scrape_run_id IN (SELECT scrape_run_id FROM runs WHERE status = 'successful') AND NOT EXISTS (SELECT 1 FROM bridge b WHERE b.job_posting_raw_id = r.job_posting_raw_id)", "ready", "runs", "bridge"),
    "ledger_update": sql("SELECT normalization_process_run_id, CASE WHEN normalization_process_run_id = 4 THEN 'failed' ELSE status END AS status, CASE WHEN normalization_process_run_id = 4 THEN 'dbt' ELSE stage END AS stage, CASE WHEN normalization_process_run_id = 4 THEN 'stopped' END AS error, normalization_process_run_id IN (1, 2, 3, 4) AS finished, len(scrape_run_ids) AS n_runs FROM ledger", "ledger"),
    "map_upsert": sql("SELECT * FROM title_map WHERE key_normalized NOT IN ('brand 1', 'brand 25') UNION ALL SELECT * FROM (VALUES ('brand 1', 'role nine', 'llm'), ('brand 25', 'role 0', 'fuzzy'))", "title_map"),
    "legacy_backfill": sql("SELECT batch_no + 1 AS scrape_run_id, batch_no, count(*) AS jobs_seen_count, min(o_orderdate) AS started_at, max(o_orderdate) AS finished_at, batch_no * 10 AS start_index FROM (SELECT o_orderdate, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 10 AS batch_no FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)) GROUP BY batch_no"),
    "dq_duplicates": sql("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "dq_orphans": sql("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "dq_accepted": sql("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1"),
    "dq_nulls": sql("SELECT 'title_raw' AS column, count(*) AS n FROM postings WHERE title_raw IS NULL", "postings"),
    "search_request_pages": sql("SELECT i // 100 AS batch_no, i AS start, 'https://jobs.example.com/search?keywords=data+engineer&geoId=103644278&f_TPR=r86400&sortBy=DD&start=' || i AS url FROM (SELECT unnest(range(0, 1000, 10)) AS i)"),
    "batch_of_three": sql("SELECT scrape_run_id, (row_number() OVER (ORDER BY scrape_run_id) - 1) // 3 AS batch_no FROM (SELECT DISTINCT scrape_run_id FROM postings)", "postings"),
    "response_class": sql("SELECT event_id, CASE event_type WHEN 'click' THEN 'successful' WHEN 'error' THEN 'failed' ELSE 'retry' END AS class FROM events"),
    "early_stop": sql(
        """SELECT batch_no, inserted FROM (SELECT *, min(CASE WHEN inserted = 0 AND before = 0 THEN batch_no END) OVER () AS stop FROM (SELECT *, lag(inserted) OVER (ORDER BY batch_no) AS before FROM
 (SELECT user_id AS batch_no, count(*) FILTER (event_type = 'purchase' AND value > 60) AS inserted FROM events GROUP BY user_id))) WHERE stop IS NULL OR batch_no <= stop"""
    ),
    "latest_posting_per_company": sql("SELECT company, job_posting_raw_id, scraped_at FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY scraped_at DESC, job_posting_raw_id DESC) AS rn FROM fact) WHERE rn = 1", "fact"),
    "skill_demand_in_window": sql("SELECT skill_name, job_posting_count, dense_rank() OVER (ORDER BY job_posting_count DESC, skill_name) AS demand_rank FROM (SELECT skill_name, count(*) AS job_posting_count FROM asked WHERE scraped_at >= TIMESTAMP '1996-01-01' AND scraped_at < TIMESTAMP '1997-01-01' GROUP BY 1)", "asked"),
    "location_rules": """WITH homes AS (SELECT c_custkey, c_custkey % 40 AS k, n_name, CASE WHEN n_regionkey = 1 THEN 'S' || n_nationkey END AS code, CASE WHEN n_regionkey = 1 THEN 'United States' ELSE n_name END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey),
 cities AS (SELECT k, code, country, count(*) AS weight FROM homes GROUP BY ALL),
 said AS (SELECT o_orderkey % 8 AS form, CASE WHEN o_orderkey % 8 = 5 AND o_orderkey % 45 < 40 THEN o_orderkey % 45 ELSE k END AS first, o_orderkey % 45 AS other, k, n_name, code, country FROM orders JOIN homes ON o_custkey = c_custkey),
 texts AS (SELECT DISTINCT CASE form WHEN 0 THEN 'Suite 5, City ' || k || ', ' || n_name || ' 10001' WHEN 1 THEN 'city ' || k WHEN 2 THEN n_name WHEN 3 THEN 'Remote' WHEN 4 THEN 'Location, ' || n_name WHEN 5 THEN 'city ' || other || '; City ' || k || ', ' || n_name WHEN 6 THEN lower(n_name) || ' - City ' || k ELSE 'City ' || k || ', ' || coalesce(code, 'USA') END AS location,
  CASE WHEN form NOT IN (2, 3, 4) THEN first END AS city, CASE WHEN form IN (0, 5, 6, 7) THEN code END AS said_state, CASE WHEN form IN (0, 5, 6) AND code IS NULL THEN country WHEN form = 7 AND code IS NULL THEN 'United States' END AS said_country,
  CASE WHEN form = 2 AND code IS NOT NULL THEN n_name || ', ' || country END AS as_state FROM said),
 ranked AS (SELECT location, 'City ' || k || ', ' || coalesce(code, country) AS value, row_number() OVER (PARTITION BY location ORDER BY coalesce(code = said_state, false) DESC, coalesce(country = said_country, false) DESC, weight DESC, country, code) AS r FROM texts JOIN cities ON k = city)
 SELECT location, coalesce(value, as_state, 'Unknown') AS value FROM texts LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (location)""",
    "title_rules": """WITH p AS (SELECT DISTINCT p_partkey % 7 AS form, CASE WHEN p_partkey % 7 = 5 THEN p_partkey END AS id, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n, p_brand FROM part),
 q AS (SELECT *, n IN ('widget', 'gizmo') AS ring, CASE WHEN n IN ('widget', 'gizmo') THEN 'Ring Makers' WHEN n <> 'anvil' THEN upper(n[1]) || n[2:] || ' Makers' ELSE 'Unknown' END AS maker FROM p),
 s AS (SELECT *, CASE WHEN a = 'hot' AND NOT ring THEN 'Hot ' || upper(n[1]) || n[2:] || ' Specialists' ELSE maker END AS full_name FROM q)
 SELECT DISTINCT CASE form WHEN 0 THEN 'Sr. ' || p_name || ', Finance Department' WHEN 1 THEN upper(p_name) WHEN 2 THEN 'Seeking ' || p_name WHEN 3 THEN a || ' Lead ' || n WHEN 4 THEN n || ' II - ' || p_brand WHEN 5 THEN 'Analyst ' || id ELSE 'Junior ' || n || ' / ring' END AS title,
  CASE form WHEN 0 THEN full_name WHEN 1 THEN full_name WHEN 3 THEN CASE WHEN n = 'bolt' THEN 'Bolt Leads' ELSE full_name END WHEN 4 THEN maker WHEN 6 THEN CASE WHEN n = 'anvil' THEN 'Ring Makers' ELSE maker END ELSE 'Unknown' END AS value FROM s""",
    "request_pauses": """WITH RECURSIVE r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type = 'error' THEN 0 ELSE 1 + event_id % 2 END AS w, event_type = 'error' AND event_id % 3 = 0 AS again FROM events),
 c AS (SELECT user_id, n, event_id, w, CAST(0 AS BIGINT) AS s, again AS sl, CAST(0 AS BIGINT) AS t, false AS rs FROM r WHERE n = 1
 UNION ALL SELECT r.user_id, r.n, r.event_id, r.w, b.s, b.s >= 12 OR r.again, b.t, b.t >= 20 FROM (SELECT user_id, n + 1 AS n, CASE WHEN sl THEN 0 ELSE s END + w AS s, CASE WHEN rs THEN 0 ELSE t END + w AS t FROM c) b JOIN r ON r.user_id = b.user_id AND r.n = b.n)
 SELECT event_id, s AS since_sleep, sl AS sleeps, t AS since_reset, rs AS resets FROM c""",
}
