"""DuckDB SQL of the named queries, written independently of the DataFrame plans."""

from __future__ import annotations


from siftline.functions.prompts import DEFAULT_INSTRUCTION
from siftline.operators import signatures as S


def _present(words: list[str], prefix: str = "") -> str:
    cells = ", ".join(f"CASE WHEN contains(code, '{w}') THEN '{prefix}{w.replace('.', '_')}' END" for w in words)
    return f"[x FOR x IN [{cells}] IF x IS NOT NULL]"


def _signature() -> str:
    calls = [f"['assert_' || x FOR x IN regexp_extract_all(code, '\\b{c}\\s*\\(')]" for c in S.CALLS]
    words = ", ".join(f"CASE WHEN regexp_matches(code, '\\b{w}\\b') THEN '{w}' END" for w in S.COLLECTIONS)
    mocks = ", ".join("CASE WHEN " + " OR ".join(f"contains(code, '{w}')" for w in words) + f" THEN '{token}' END" for words, token in S.MOCKS)
    parts = [
        r"regexp_extract_all(code, '\b(\w+)\.\w+\s*\(', 1)",
        _present(S.ANNOTATIONS),
        rf"['assert_' || x FOR x IN regexp_extract_all(code, '{S.ASSERTS}', 1)]",
        *calls,
        _present(S.CONCURRENCY, "async_"),
        _present(S.TIME, "time_"),
        f"[x FOR x IN [{words}] IF x IS NOT NULL]",
        _present(S.IO, "io_"),
        f"[x FOR x IN [{mocks}] IF x IS NOT NULL]",
        _present(S.DATABASE, "db_"),
    ]
    return "flatten([" + ",\n    ".join(parts) + "])"


SIG = f"sigs AS (SELECT id, {_signature()} AS sig FROM dataset)"
TF = f"""{SIG},
tf AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(sig) AS token FROM sigs) GROUP BY ALL),
sz AS (SELECT id, len(list_distinct(sig)) AS u, len(sig) AS t FROM sigs)"""


def _sims(left: str, name: str) -> str:
    """Similarity of the ids of ``left`` (query_id, q) with every row."""
    return f"""{name}_hit AS (
  SELECT l.query_id, l.q, b.id AS cand_id, count(*) AS inter, sum(least(a.n, b.n)) AS shared
  FROM {left} l JOIN tf a ON a.id = l.q JOIN tf b ON b.token = a.token GROUP BY ALL),
{name} AS (
  SELECT l.query_id, l.q, c.id AS cand_id,
    CASE WHEN h.inter IS NULL THEN 0.0::DOUBLE
         ELSE 0.6::DOUBLE * (h.inter / (x.u + c.u - h.inter)::DOUBLE) + 0.4::DOUBLE * (h.shared / (x.t + c.t)::DOUBLE) END AS sim
  FROM {left} l JOIN sz x ON x.id = l.q CROSS JOIN sz c
  LEFT JOIN {name}_hit h ON h.query_id = l.query_id AND h.q = l.q AND h.cand_id = c.id)"""


QUERIES = "qs AS (SELECT id AS query_id, id AS q FROM dataset WHERE id % 100 = 0)"


def _top(k: int, least: float) -> str:
    return f"""WITH {TF}, {QUERIES}, {_sims("qs", "s")},
hits AS (SELECT query_id, cand_id, sim AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) AS rank
  FROM s WHERE cand_id <> query_id AND sim >= {least}),
top AS (SELECT query_id, rank, cand_id, similarity FROM hits WHERE rank <= {k})"""


def _diverse() -> str:
    rounds, taken = [], "SELECT query_id, cand_id FROM p1"
    rounds.append("p1 AS (SELECT query_id, cand_id, sim FROM s WHERE cand_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) = 1)")
    for r in (2, 3):
        rounds.append(f"l{r} AS (SELECT query_id, cand_id AS q FROM ({taken}))")
        rounds.append(_sims(f"l{r}", f"n{r}"))
        rounds.append(
            f"p{r} AS (SELECT query_id, cand_id, sim FROM s WHERE cand_id <> query_id"
            f" AND NOT EXISTS (FROM n{r} n WHERE n.query_id = s.query_id AND n.cand_id = s.cand_id AND (n.sim > 0.3 OR n.q = s.cand_id))"
            f" QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) = 1)"
        )
        taken += f" UNION ALL SELECT query_id, cand_id FROM p{r}"
    return f"""WITH {TF}, {QUERIES}, {_sims("qs", "s")}, {", ".join(rounds)},
picked AS (SELECT query_id, 1 AS rank, cand_id, sim FROM p1 UNION ALL SELECT query_id, 2, cand_id, sim FROM p2 UNION ALL SELECT query_id, 3, cand_id, sim FROM p3),
fill AS (SELECT s.query_id, (SELECT count(*) FROM picked p WHERE p.query_id = s.query_id) + row_number() OVER (PARTITION BY s.query_id ORDER BY s.sim DESC, s.cand_id) AS rank, s.cand_id, s.sim
  FROM s ANTI JOIN picked p ON p.query_id = s.query_id AND p.cand_id = s.cand_id WHERE s.cand_id <> s.query_id)
SELECT query_id, rank, cand_id, sim AS similarity FROM picked UNION ALL SELECT * FROM fill WHERE rank <= 3"""


PAIRS = f"""WITH {SIG},
named AS (SELECT DISTINCT id AS id_a, e.id AS id_b FROM (SELECT id, unnest(few_shot_examples) AS e FROM alpaca_item)),
pairs AS (SELECT id_a, id_b, a.sig AS a, b.sig AS b FROM named JOIN sigs a ON a.id = id_a JOIN sigs b ON b.id = id_b),
m AS (SELECT id_a, id_b, len(list_intersect(a, b)) AS n_inter, len(list_distinct(list_concat(a, b))) AS n_union, len(a) + len(b) AS t,
  list_sum([least(len([y FOR y IN a IF y = x]), len([y FOR y IN b IF y = x])) FOR x IN list_intersect(a, b)]) AS shared FROM pairs),
r AS (SELECT id_a, id_b, n_inter, n_union, CASE WHEN n_union = 0 THEN 0.0::DOUBLE ELSE n_inter / n_union::DOUBLE END AS jaccard,
  CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE coalesce(shared, 0) / t::DOUBLE END AS overlap FROM m)"""

NORMAL = """CASE WHEN {0} IS NULL OR {0} = '' THEN 'Unknown' ELSE coalesce(CASE upper({0})
  WHEN 'ASYNC' THEN 'Async' WHEN 'ASYNC WAIT' THEN 'Async' WHEN 'ASYNC.' THEN 'Async'
  WHEN 'CONC' THEN 'Conc' WHEN 'CONC.' THEN 'Conc' WHEN 'CONCURRENCY' THEN 'Conc'
  WHEN 'TIME' THEN 'Time' WHEN 'TIME.' THEN 'Time'
  WHEN 'UC' THEN 'UC' WHEN 'UNORDERED COLLECTIONS' THEN 'UC' WHEN 'UNORDERED COLLECTION' THEN 'UC'
  WHEN 'OD' THEN 'OD' WHEN 'ORDER DEPENDENCY' THEN 'OD' WHEN 'TEST ORDER DEPENDENCY' THEN 'OD'
  WHEN 'NON-FLAKY' THEN 'Non-Flaky' WHEN 'NONFLAKY' THEN 'Non-Flaky' WHEN 'NON FLAKY' THEN 'Non-Flaky' END, {0}) END"""
BARE = "lower(trim(coalesce(label, 'nan'), ' '))"
TRUTH = f"""truth AS (SELECT id, CASE WHEN {BARE} IN ('non-flaky', 'nonflaky') THEN '否' ELSE '是' END AS is_flaky,
  CASE WHEN {BARE} IN ('non-flaky', 'nonflaky') THEN 'Non-Flaky' ELSE {NORMAL.format(BARE)} END AS category FROM dataset)"""
PARSED = f"""parsed AS (SELECT * FROM (SELECT id, CASE WHEN lower(is_flaky) IN ('yes', '是') THEN '是' WHEN lower(is_flaky) IN ('no', '否') THEN '否' END AS is_flaky,
  {NORMAL.format("category")} AS category, config_id, predicted_at, received_at, category AS raw FROM prediction) WHERE is_flaky IS NOT NULL AND raw IS NOT NULL)"""
PRED = "pred AS (SELECT id, is_flaky, category FROM parsed WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY predicted_at DESC, received_at DESC, config_id DESC, is_flaky DESC, category DESC) = 1)"
ALIGNED = f"""WITH {TRUTH}, {PARSED}, {PRED},
aligned AS (SELECT p.id, p.is_flaky AS pred_flaky, p.category AS pred_category, t.is_flaky AS true_flaky, t.category AS true_category FROM pred p JOIN truth t USING (id))"""


def _metrics(source: str, by: str = "") -> str:
    return f"""counted AS (SELECT {by} count(*) AS total,
  count_if(pred_flaky = true_flaky AND pred_category = true_category) AS b, count_if(pred_flaky = true_flaky) AS v, count_if(pred_category = true_category) AS c,
  count_if(pred_flaky = '是' AND true_flaky = '是') AS tp, count_if(pred_flaky = '是' AND true_flaky <> '是') AS fp,
  count_if(pred_flaky <> '是' AND true_flaky <> '是') AS tn, count_if(pred_flaky <> '是' AND true_flaky = '是') AS fn
  FROM {source} {"GROUP BY ALL" if by else ""}),
rated AS (SELECT *, coalesce(b / nullif(total, 0), 0)::DOUBLE AS overall_accuracy, coalesce(v / nullif(total, 0), 0)::DOUBLE AS verdict_accuracy,
  coalesce(c / nullif(total, 0), 0)::DOUBLE AS category_accuracy, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall FROM counted),
metrics AS (SELECT * EXCLUDE (b, v, c), coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1 FROM rated)"""


ERRORS = ALIGNED + """,
errors AS (SELECT id, pred_flaky || ' - ' || pred_category AS predicted, true_flaky || ' - ' || true_category AS actual,
  CASE WHEN pred_flaky <> true_flaky AND pred_category <> true_category THEN 'both' WHEN pred_flaky <> true_flaky THEN 'flaky' ELSE 'category' END AS error_type,
  pred_category, true_category FROM aligned WHERE pred_flaky <> true_flaky OR pred_category <> true_category)"""

ANSWER = r"""regexp_extract(output, '(?i)答案[：:]\s*(是|否)\s*[-–—]\s*([\pL\pM\pN_]+[-\pL\pM\pN_]*)', {0})"""
ANSWER_EN = r"""regexp_extract(output, '(?i)Answer[：:]\s*(Yes|No|是|否)\s*[-–—]\s*([\pL\pM\pN_]+[-\pL\pM\pN_]*)', {0})"""
ANSWERS = f"""answers AS (SELECT item_id, id, CASE WHEN v IN ('yes', '是') THEN '是' WHEN v IN ('no', '否') THEN '否' END AS is_flaky, c AS category FROM (
  SELECT item_id, id, lower(coalesce(nullif({ANSWER.format(1)}, ''), nullif({ANSWER_EN.format(1)}, ''))) AS v,
  coalesce(nullif({ANSWER.format(2)}, ''), nullif({ANSWER_EN.format(2)}, '')) AS c FROM alpaca_item))"""


def _split(place: str, total: str) -> str:
    a, b = f"floor({total} * 0.7::DOUBLE)", f"floor({total} * 0.2::DOUBLE)"
    return f"CASE WHEN {place} < {a} THEN 'train' WHEN {place} < {a} + {b} THEN 'valid' ELSE 'test' END"


SHUFFLED = "md5('42:' || id::VARCHAR), id"
STRATIFIED = f"strat AS (SELECT id, label, {_split('row_number() OVER (PARTITION BY label ORDER BY ' + SHUFFLED + ') - 1', 'count(*) OVER (PARTITION BY label)')} AS split FROM dataset WHERE label IS NOT NULL)"
FOLDED = "folded AS (SELECT f.fold, d.* FROM dataset d JOIN fold_project f ON f.project = d.project AND f.side = 'test')"
INPUT = "'该测试代码所属project的名称为' || coalesce(project, 'Unknown') || '，它的测试名称为' || coalesce(test_name, 'Unknown') || '，完整代码为' || coalesce(code, '') || '。'"
RARE = "rare AS (SELECT category, count(*) AS n_rows FROM dataset WHERE category IS NOT NULL GROUP BY category HAVING count(*) < (SELECT count(*) FROM dataset) * 0.02::DOUBLE)"
CRITICAL = f"""WITH {RARE}, crit AS (SELECT project, n_rows, (row_number() OVER (ORDER BY n_rows DESC, project) - 1) % 4 + 1 AS fold FROM (
  SELECT project, count(*) AS n_rows FROM dataset WHERE project IS NOT NULL GROUP BY project) WHERE project IN (SELECT project FROM dataset WHERE category IN (SELECT category FROM rare)))"""
BLOCK = r"""(E'\n\n参考案例（根据API签名相似度检索）：\n' || repeat('=', 60) || E'\n' || string_agg(E'\n【案例 ' || rank || '】(相似度: ' || printf('%.2f', similarity) || E')\n项目: ' || coalesce(c.project, 'Unknown')
  || E'\n标签: ' || coalesce(c.label, 'Unknown') || E'\n代码:\n' || c.code || E'\n' || repeat('-', 60) || E'\n', '' ORDER BY rank))"""


# the greedy assignment of projects to folds, one project a step
KFOLD = """WITH RECURSIVE cats AS (SELECT category, count(*) AS total FROM dataset WHERE project IS NOT NULL AND category IS NOT NULL GROUP BY category),
sums AS (SELECT (SELECT count(*) FROM dataset WHERE project IS NOT NULL) AS n_all),
goals AS (SELECT list(total / 4::DOUBLE ORDER BY category) AS want, list(total < 0.02::DOUBLE * n_all ORDER BY category) AS rare, any_value(n_all) / 4::DOUBLE AS goal, range(1, count(*) + 1) AS places FROM cats, sums),
sizes AS (SELECT project, count(*) AS n FROM dataset WHERE project IS NOT NULL GROUP BY project),
cells AS (SELECT s.project, s.n, c.category, (SELECT count(*) FROM dataset d WHERE d.project = s.project AND d.category = c.category) AS own, c.total < 0.02::DOUBLE * n_all AS rare FROM sizes s, cats c, sums),
owns AS (SELECT project, any_value(n) AS n, list(own ORDER BY category) AS own, bool_or(rare AND own > 0) AS critical FROM cells GROUP BY project),
seq AS (SELECT *, row_number() OVER (ORDER BY critical DESC, n DESC, project) AS i FROM owns),
run AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS project, NULL::BIGINT AS fold, [0, 0, 0, 0]::BIGINT[] AS size, [[0 FOR c IN places] FOR x IN [1, 2, 3, 4]]::BIGINT[][] AS have FROM goals
  UNION ALL
  SELECT i, project, fold, [size[x] + CASE WHEN x = fold THEN n ELSE 0 END FOR x IN [1, 2, 3, 4]], [[have[x][c] + CASE WHEN x = fold THEN own[c] ELSE 0 END FOR c IN places] FOR x IN [1, 2, 3, 4]]
  FROM (SELECT * EXCLUDE (scores), CASE WHEN critical THEN (i - 1) % 4 + 1 ELSE list_position(scores, list_min(scores)) END AS fold
    FROM (SELECT s.i, s.project, s.n, s.own, s.critical, r.size, r.have, g.places,
        [0.1::DOUBLE * abs(r.size[x] + s.n - g.goal) + list_sum([CASE WHEN g.rare[c] AND r.have[x][c] < 4 AND s.own[c] > 0 THEN -100::DOUBLE ELSE abs(r.have[x][c] + s.own[c] - g.want[c]) END FOR c IN g.places]) FOR x IN [1, 2, 3, 4]] AS scores
      FROM run r JOIN seq s ON s.i = r.i + 1, goals g))),
folds AS (SELECT project, fold::INT AS fold FROM run WHERE project IS NOT NULL),
sides AS (SELECT k.fold::INT AS fold, CASE WHEN k.fold = f.fold THEN 'test' ELSE 'train' END AS side, d.id, d.project FROM dataset d JOIN folds f ON f.project = d.project, range(1, 5) k(fold))"""
DISTILLED = f""", shots AS (SELECT query_id, {BLOCK} AS block, count(*) AS n FROM top JOIN dataset c ON c.id = cand_id GROUP BY query_id),
asked AS (SELECT id, {INPUT} AS input, block, n, code FROM dataset LEFT JOIN shots ON query_id = id WHERE id % 100 = 0),
prompts AS (SELECT *, CASE WHEN block IS NULL OR code = '' THEN input ELSE replace(input, code, block || E'\\n待分析的测试代码:\\n' || code) END AS prompt FROM asked),
kinds AS (SELECT *, CASE WHEN contains(prompt, 'currentTimeMillis') THEN 'Time' WHEN contains(prompt, 'Thread.sleep') THEN 'Async' WHEN contains(prompt, 'synchronized') THEN 'Conc' ELSE 'Non-Flaky' END AS kind FROM prompts)
SELECT row_number() OVER (ORDER BY id) - 1 AS row_index, id, '{DEFAULT_INSTRUCTION}' AS instruction, input, E'<think>rule</think>\\n<answer>答案：' || CASE WHEN kind = 'Non-Flaky' THEN '否' ELSE '是' END || ' - ' || kind || '</answer>' AS output, n::INT AS n_examples FROM kinds"""


def _profile(table: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_null, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS percent_null FROM {table}" for c, t in columns)


DATASET = [("id", "bigint"), ("project", "string"), ("test_name", "string"), ("code", "string"), ("label", "string"), ("category", "int"), ("split", "string"), ("collected_at", "timestamp"), ("loaded_at", "timestamp")]
ITEM = [(c, "") for c in ("item_id", "id", "instruction", "input", "output", "few_shot_examples", "source", "created_at", "received_at")]


def oracle_sql() -> dict[str, str]:
    d = "SELECT {} FROM dataset"
    return {
        "extract_apis": f"WITH {SIG} SELECT id, (i - 1)::INT AS pos, sig[i] AS token FROM (SELECT id, sig, unnest(range(1, len(sig) + 1)) AS i FROM sigs)",
        "signature_statistics": f"WITH {SIG}, t AS (SELECT unnest(sig) AS token FROM sigs) SELECT (SELECT count(*) FROM sigs) AS n_rows, count(DISTINCT token) AS n_distinct, count(*) AS n_tokens, count(*) / (SELECT count(*) FROM sigs)::DOUBLE AS mean_tokens FROM t",
        "top_tokens": f"WITH {SIG} SELECT token, count(*) AS n FROM (SELECT unnest(sig) AS token FROM sigs) GROUP BY token ORDER BY n DESC, token LIMIT 10",
        "jaccard": PAIRS + " SELECT id_a, id_b, jaccard FROM r",
        "frequency_overlap": PAIRS + " SELECT id_a, id_b, overlap FROM r",
        "compute_similarity": PAIRS + " SELECT id_a, id_b, 0.6::DOUBLE * jaccard + 0.4::DOUBLE * overlap AS similarity FROM r",
        "signature_union_intersection": PAIRS + " SELECT id_a, id_b, n_union::INT AS n_union, n_inter::INT AS n_inter FROM r",
        "similarity_join": f"WITH {TF}, {QUERIES}, {_sims('qs', 's')} SELECT query_id, cand_id, inter, shared::BIGINT AS shared FROM s_hit WHERE query_id <> cand_id",
        "min_similarity_filter": f"WITH {TF}, {QUERIES}, {_sims('qs', 's')} SELECT query_id, cand_id, sim AS similarity FROM s WHERE cand_id <> query_id AND sim >= 0.5",
        "retrieve_top_k": _top(3, 0.1) + " SELECT query_id, rank::INT AS rank, cand_id, similarity FROM top",
        "retrieve_top_k_padded": _top(5, 0.0) + " SELECT query_id, rank::INT AS rank, cand_id, similarity FROM top",
        "batch_retrieve": _top(3, 0.0) + " SELECT query_id, rank::INT AS rank, cand_id, similarity FROM top",
        "retrieve_with_diversity": _diverse(),
        "row_fetch": _top(3, 0.1) + " SELECT query_id, rank::INT AS rank, c.project, c.label FROM top JOIN dataset c ON c.id = cand_id",
        "format_prompt": d.format(r"id, coalesce(project, '') || '/' || coalesce(test_name, '') || E'\n' || coalesce(code, '') AS prompt"),
        "code_preview": d.format("id, code[1:200] AS preview"),
        "to_instruction": f"""WITH {TRUTH}, last AS (SELECT id, few_shot_examples FROM alpaca_item WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY item_id DESC) = 1)
SELECT '{DEFAULT_INSTRUCTION}' AS instruction, {INPUT} AS input, '答案：' || is_flaky || ' - ' || truth.category AS output, id, '[' || array_to_string([x.id FOR x IN few_shot_examples], ',') || ']' AS examples FROM dataset JOIN truth USING (id) LEFT JOIN last USING (id)""",
        "distill": _top(3, 0.1) + DISTILLED,
        "api_call_stats": "SELECT count(*) AS n_rows, count(code) AS calls, 0::BIGINT AS failures, count(code) AS n_output, 0::BIGINT AS tokens, CASE WHEN count(code) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS success_rate FROM dataset",
        "strip_metadata": "SELECT item_id, instruction, input, output FROM alpaca_item",
        "fewshot_block": _top(3, 0.1)
        + f""", blocks AS (SELECT query_id, {BLOCK} AS block FROM top JOIN dataset c ON c.id = cand_id GROUP BY query_id),
base AS (SELECT id, code, coalesce(project, 'Unknown') || '/' || coalesce(test_name, 'Unknown') || E'\\n' || code AS base FROM dataset WHERE id % 100 = 0)
SELECT id, CASE WHEN block IS NULL THEN base ELSE replace(base, code, block || E'\\n待分析的测试代码:\\n' || code) END AS prompt FROM base LEFT JOIN blocks ON query_id = id""",
        "fewshot_examples": _top(3, 0.1) + " SELECT query_id, rank::INT AS rank, similarity, c.project, coalesce(c.test_name, 'Unknown') AS test_name, c.label, c.code[1:200] AS code_preview, cand_id AS example_id FROM top JOIN dataset c ON c.id = cand_id",
        "explainer_prompt": rf"""WITH s AS (SELECT * FROM dataset ORDER BY {SHUFFLED} LIMIT 5)
SELECT count(*)::VARCHAR || E'\n' || E'\n\n' || repeat('-', 60) || string_agg('样本 ' || rank || E':\n标签: ' || coalesce(label, 'Unknown') || E'\n代码:\n```\n' || code || E'\n```', E'\n\n' ORDER BY rank) AS prompt
FROM (SELECT *, row_number() OVER (ORDER BY id) AS rank FROM s)""",
        "extract_answer": f"WITH {ANSWERS} SELECT item_id, is_flaky, category FROM answers",
        "normalize_category": f"SELECT DISTINCT category, {NORMAL.format('category')} AS known FROM prediction",
        "truth_verdict": f"WITH {TRUTH} SELECT * FROM truth",
        "scan_predictions": f"""WITH {ANSWERS}, placed AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM answers)
SELECT key AS id, is_flaky, {NORMAL.format("category")} AS category FROM (SELECT coalesce(id, pos) AS key, * EXCLUDE (id) FROM placed WHERE is_flaky IS NOT NULL AND category IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1""",
        "scan_ground_truth": f"WITH {TRUTH} SELECT * FROM truth",
        "drop_unparsed": f"WITH {PARSED} SELECT id, is_flaky, category, config_id FROM parsed",
        "align_inner_join": ALIGNED + " SELECT * FROM aligned",
        "unmatched_predictions": ALIGNED + " SELECT * FROM pred WHERE id NOT IN (SELECT id FROM truth)",
        "unmatched_labels": ALIGNED + " SELECT * FROM truth WHERE id NOT IN (SELECT id FROM pred)",
        "id_intersection": ALIGNED + " SELECT id FROM pred INTERSECT SELECT id FROM truth",
        "overall_metrics": f"{ALIGNED}, {_metrics('aligned')} SELECT * FROM metrics",
        "flaky_confusion": f"{ALIGNED}, {_metrics('aligned')} SELECT tp, fp, tn, fn FROM metrics",
        "flaky_prf": f"{ALIGNED}, {_metrics('aligned')} SELECT precision, recall, f1 FROM metrics",
        "per_category_metrics": ALIGNED
        + """, known AS (SELECT unnest(['Async', 'Conc', 'Time', 'UC', 'OD', 'Non-Flaky']) AS category),
c AS (SELECT k.category, (SELECT count(*) FROM aligned WHERE true_category = k.category) AS total, (SELECT count(*) FROM aligned WHERE true_category = k.category AND pred_category = k.category) AS tp,
  (SELECT count(*) FROM aligned WHERE true_category <> pred_category AND pred_category = k.category AND true_category IN (FROM known)) AS fp FROM known k),
r AS (SELECT *, total - tp AS fn, (tp / total)::DOUBLE AS recall, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision FROM c WHERE total > 0)
SELECT category, total, tp, fn, fp, recall AS accuracy, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1 FROM r""",
        "error_cases": ERRORS + " SELECT id, predicted, actual, error_type FROM errors",
        "error_transition_counts": ERRORS + " SELECT true_category AS actual_category, pred_category AS predicted_category, count(*) AS n FROM errors WHERE error_type <> 'flaky' GROUP BY ALL",
        "error_group_counts": ERRORS + " SELECT count_if(error_type <> 'category') AS n_flaky, count_if(error_type <> 'flaky') AS n_category FROM errors",
        "top_errors_limit": ERRORS
        + """, kinds AS (SELECT id, predicted, actual, error_type, 'flaky' AS kind FROM errors WHERE error_type <> 'category' UNION ALL SELECT id, predicted, actual, error_type, 'category' FROM errors WHERE error_type <> 'flaky')
SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id)::INT AS rank FROM kinds QUALIFY rank <= 20""",
        "category_distribution": f"WITH {TRUTH}, n AS (SELECT category, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM truth) AS percent FROM truth GROUP BY category) SELECT *, repeat('█', floor(percent / 2)::INT) AS bar FROM n",
        "performance_bands": f"{ALIGNED}, {_metrics('aligned')} SELECT CASE WHEN f1 >= 0.9 THEN 'excellent' WHEN f1 >= 0.7 THEN 'good' ELSE 'poor' END AS flaky_band, CASE WHEN category_accuracy >= 0.8 THEN 'excellent' WHEN category_accuracy >= 0.6 THEN 'good' ELSE 'poor' END AS category_band FROM metrics",
        "format_percentage": f"{ALIGNED}, {_metrics('aligned')} SELECT " + ", ".join(f"printf('%.2f%%', {c} * 100) AS {c}" for c in ("overall_accuracy", "verdict_accuracy", "category_accuracy", "precision", "recall", "f1")) + " FROM metrics",
        "model_comparison": f"""WITH {TRUTH}, {PARSED}, last AS (SELECT * FROM parsed WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY config_id, id ORDER BY predicted_at DESC, received_at DESC, is_flaky DESC, category DESC) = 1),
both_ AS (SELECT config_id, p.is_flaky AS pred_flaky, p.category AS pred_category, t.is_flaky AS true_flaky, t.category AS true_category FROM last p JOIN truth t USING (id)), {_metrics("both_", "config_id,")} SELECT * FROM metrics""",
        "sample_all": d.format("id, label"),
        "sample_first": d.format("id, label") + " ORDER BY id LIMIT 100",
        "sample_last": d.format("id, label") + " ORDER BY id DESC LIMIT 100",
        "sample_random": d.format("id, label") + f" ORDER BY {SHUFFLED} LIMIT 100",
        "shuffle_rows": d.format("id, label") + f" ORDER BY {SHUFFLED}",
        "random_split": d.format(f"id, label, {_split('row_number() OVER (ORDER BY ' + SHUFFLED + ') - 1', 'count(*) OVER ()')} AS split"),
        "ordered_split": d.format(f"id, label, {_split('row_number() OVER (ORDER BY id) - 1', 'count(*) OVER ()')} AS split"),
        "stratified_split": f"WITH {STRATIFIED} SELECT * FROM strat",
        "split_summary": f"WITH {STRATIFIED} SELECT split, label, count(*) AS n_rows, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY label) AS percent FROM strat GROUP BY split, label",
        "concat_splits": d.format("id, label") + " WHERE split IS NOT NULL",
        "category_project_spread": "SELECT category, count(*) AS n_rows, count(DISTINCT project) AS n_projects FROM dataset WHERE category IS NOT NULL GROUP BY category",
        "project_category_counts": "SELECT project, category, count(*) AS n_rows FROM dataset GROUP BY ALL",
        "rare_categories": f"WITH {RARE} SELECT * FROM rare",
        "fold_feasibility": "SELECT category, count(*) AS n_rows, count(*) / 4.0::DOUBLE AS per_fold FROM dataset WHERE category IS NOT NULL GROUP BY category HAVING count(*) / 4.0 < 20",
        "kfold_round_robin": CRITICAL + " SELECT project, n_rows, fold::INT AS fold FROM crit",
        "project_difference": CRITICAL + " SELECT DISTINCT project FROM dataset WHERE project IS NOT NULL AND project NOT IN (SELECT project FROM crit)",
        "kfold_greedy_assign": KFOLD + " SELECT project, fold FROM folds",
        "kfold_materialise": KFOLD + " SELECT fold, side, id, project FROM sides",
        "save_fold_sides": KFOLD + " SELECT fold, side, count(*) AS n_rows, count(DISTINCT project) AS n_projects FROM sides GROUP BY ALL",
        "categories_in_order": "SELECT category, count(*) AS n_rows, count(DISTINCT project) AS n_projects FROM dataset WHERE category IS NOT NULL GROUP BY category ORDER BY category",
        "global_counts": "SELECT count(*) AS n_rows, count(DISTINCT project) AS n_projects, count(DISTINCT category) AS n_categories FROM dataset",
        # an empty field is null
        "scan_csv": d.format("id, nullif(project, '') AS project, nullif(test_name, '') AS test_name, nullif(code, '') AS full_code, nullif(label, '') AS label, category"),
        "scan_json": "SELECT instruction, input, output, id, coalesce(len(few_shot_examples), 0)::INT AS n_examples FROM alpaca_item",
        "save_splits": f"WITH {STRATIFIED} SELECT * FROM strat",
        "save_items": "SELECT 'run' AS name, count(*) AS n_rows, count(output) AS n_output, 0::BIGINT AS n_id FROM alpaca_item UNION ALL SELECT 'run_external', count(*), count(output), count(id) FROM alpaca_item",
        "resume": f"WITH {TRUTH} SELECT id, is_flaky FROM truth",
        "drop_failed": "SELECT id, 1::INT AS calls, 0::INT AS failures FROM dataset WHERE code IS NOT NULL AND NOT contains(code, 'Thread.sleep')",
        "explain_report": "SELECT (SELECT count(*) FROM dataset) AS total_records, 9::INT AS n_columns, label, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM dataset) AS percent FROM dataset WHERE label IS NOT NULL GROUP BY label",
        "evaluation_report": f"""{ERRORS}, {_metrics("aligned")}, kinds AS (SELECT id, row_number() OVER (PARTITION BY kind ORDER BY id) AS rank FROM (SELECT id, 'flaky' AS kind FROM errors WHERE error_type <> 'category' UNION ALL SELECT id, 'category' FROM errors WHERE error_type <> 'flaky'))
SELECT total AS total_samples, overall_accuracy, precision, recall, f1, tp, fp, tn, fn, category_accuracy, (SELECT count(DISTINCT id) FROM kinds WHERE rank <= 20)::INT AS n_errors,
  (SELECT count(*) FROM pred WHERE id NOT IN (SELECT id FROM truth)) AS unmatched_predictions, (SELECT count(*) FROM truth WHERE id NOT IN (SELECT id FROM pred)) AS unmatched_labels FROM metrics""",
        "fold_summary": f"WITH {FOLDED} SELECT fold, category, count(*) AS n_rows, count(DISTINCT project) AS n_projects FROM folded GROUP BY ALL",
        "fold_violations": f"WITH {FOLDED} SELECT f.fold::INT AS fold, c.category, count(d.id) AS n_rows FROM range(1, 5) f(fold) CROSS JOIN (SELECT DISTINCT category FROM folded WHERE category IS NOT NULL) c LEFT JOIN folded d ON d.fold = f.fold AND d.category = c.category GROUP BY ALL HAVING count(d.id) < 40",
        "overlap_check": "SELECT 1::INT AS fold, project FROM (SELECT project FROM dataset WHERE project IS NOT NULL AND split = 'train' INTERSECT SELECT project FROM dataset WHERE project IS NOT NULL AND split IS DISTINCT FROM 'train')",
        "save_folds": r"SELECT fold, side, count(DISTINCT project)::INT AS n_projects, string_agg(DISTINCT project, E'\n' ORDER BY project) AS projects FROM fold_project GROUP BY fold, side",
        "project_membership": d.format("id, project") + " WHERE project IS NOT NULL AND project NOT IN (SELECT project FROM fold_project) UNION ALL SELECT id, project FROM dataset WHERE project IS NULL",
        "profile_table": _profile("dataset", DATASET),
        "null_percentages": f'SELECT "column", n_null, percent_null FROM ({_profile("alpaca_item", ITEM)}) WHERE n_null > 0',
        "label_percentages": "SELECT label, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM dataset) AS percent FROM dataset WHERE label IS NOT NULL GROUP BY label",
        "preview_head": d.format("id, project, label") + " ORDER BY id LIMIT 3",
        "fewshot_similarity_stats": "WITH s AS (SELECT unnest(few_shot_examples).similarity AS s FROM alpaca_item) SELECT (SELECT count(*) FROM alpaca_item) AS n_items, (SELECT count(*) FROM alpaca_item WHERE len(few_shot_examples) > 0) AS n_with, avg(s) AS mean, median(s) AS median, stddev_pop(s) AS std, min(s) AS low, max(s) AS high, (SELECT count_if(len(few_shot_examples) > 0) / count(*)::DOUBLE FROM alpaca_item) AS usage_rate FROM s",
        "fewshot_distribution": "SELECT e.label AS value, count(*) AS n FROM (SELECT unnest(few_shot_examples) AS e FROM alpaca_item) GROUP BY ALL",
        "fewshot_low_quality": "SELECT item_id, mean_similarity FROM (SELECT item_id, list_sum([x.similarity FOR x IN few_shot_examples]) / len(few_shot_examples) AS mean_similarity FROM alpaca_item WHERE len(few_shot_examples) > 0) WHERE mean_similarity < 0.3",
    }
