"""DuckDB oracle SQL for the registered queries (views: the given tables by name).

Each oracle computes its answer its own way (window numbering, list functions, recursive
CTEs for the clustering steps) so agreement is evidence, not a tautology.
"""

from __future__ import annotations

from ..constants import DEFAULT_ALPHA, DEFAULT_THRESHOLD


LEVELS = [x / 10.0 for x in range(1, 51)]


def _d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


F1 = """f1 AS (
  SELECT CAST(vec_id // 50 AS VARCHAR) AS input_id, vec_id,
         CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS INTEGER) AS gold,
         CAST(row_number() OVER (PARTITION BY vec_id // 50 ORDER BY label, vec_id) - 1 AS INTEGER) AS page_no
  FROM embeddings)"""


def _pairs_cte(alpha: float, src: str = "f1", vec: str = "embedding", name: str = "base", decimals: int | None = 9) -> str:
    d = f"{_d(alpha)} * list_distance(a.{vec}, b.{vec}) + {_d(1.0 - alpha)} * CAST(abs(a.page_no - b.page_no) AS DOUBLE)"
    if decimals is not None:
        d = f"round({d}, {decimals})"
    return f"""{name} AS (
  SELECT a.input_id, a.page_no AS i, b.page_no AS j, {d} AS d
  FROM {src} a JOIN {src} b ON a.input_id = b.input_id AND a.page_no < b.page_no)"""


def cluster_ctes(src: str, alpha: float, threshold: float, linkage: str, vec: str = "embedding", name: str = "labels") -> str:
    """CTEs ending in ``{name}(input_id, page_no, label)``: greedy merging as a recursive CTE;
    each step merges, per input, the least (linkage distance, low id, high id) pair below the
    threshold; ids are lowest pages. Needs ``WITH RECURSIVE``."""
    agg = {"average": "avg", "complete": "max", "single": "min"}[linkage]
    b = f"{name}_base"
    st = f"{name}_steps"
    return f"""{_pairs_cte(alpha, src, vec, name=b)},
{st}(step, input_id, page_no, cl) AS (
  SELECT 0, input_id, page_no, page_no FROM {src}
  UNION ALL
  SELECT s.step + 1, s.input_id, s.page_no, CASE WHEN s.cl = m.cb THEN m.ca ELSE s.cl END
  FROM {st} s JOIN (
    SELECT input_id, arg_min(ca, k) AS ca, arg_min(cb, k) AS cb FROM (
      SELECT b.input_id, least(x.cl, y.cl) AS ca, greatest(x.cl, y.cl) AS cb,
             round({agg}(b.d), 9) AS v, (round({agg}(b.d), 9), least(x.cl, y.cl), greatest(x.cl, y.cl)) AS k
      FROM {b} b
      JOIN {st} x ON x.input_id = b.input_id AND x.page_no = b.i
      JOIN {st} y ON y.input_id = b.input_id AND y.page_no = b.j
      WHERE x.cl <> y.cl
      GROUP BY b.input_id, least(x.cl, y.cl), greatest(x.cl, y.cl)
    ) WHERE v < {_d(threshold)} GROUP BY input_id
  ) m ON s.input_id = m.input_id
),
{name} AS (SELECT input_id, page_no, CAST(arg_max(cl, step) AS INTEGER) AS label FROM {st} GROUP BY input_id, page_no)"""


def cluster_sql(pages_cte: str, src: str, alpha: float, threshold: float, linkage: str, vec: str = "embedding") -> str:
    return f"WITH RECURSIVE {pages_cte},\n{cluster_ctes(src, alpha, threshold, linkage, vec)}\nSELECT input_id, page_no, label FROM labels"


def registry() -> dict[str, str]:
    a = DEFAULT_ALPHA
    o: dict[str, str] = {}
    o["page_numbering"] = f"WITH {F1} SELECT input_id, vec_id, page_no, gold FROM f1"
    o["l2_distance"] = f"""WITH {F1}
SELECT a.input_id, a.page_no, round(list_distance(a.embedding, b.embedding), 6) AS l2
FROM f1 a JOIN f1 b ON a.input_id = b.input_id AND b.page_no = a.page_no + 1"""
    o["page_distance"] = f"""WITH {F1}
SELECT a.input_id, a.page_no AS i, b.page_no AS j, CAST(b.page_no - a.page_no AS INTEGER) AS page_dist
FROM f1 a JOIN f1 b ON a.input_id = b.input_id AND a.page_no < b.page_no"""
    o["blended_distance"] = f"WITH {F1}, {_pairs_cte(1.2, decimals=None)} SELECT input_id, i, j, round(d, 6) AS dist FROM base"
    o["page_pairs"] = f"WITH {F1}, {_pairs_cte(a, decimals=None)} SELECT input_id, i, j, round(d, 6) AS dist FROM base"
    o["cosine_similarity"] = f"""WITH {F1},
cells AS (SELECT input_id, page_no, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM f1),
mean AS (SELECT input_id, dim, avg(x) AS m FROM cells GROUP BY input_id, dim),
dots AS (SELECT c.input_id, c.page_no, sum(c.x * m.m) AS dot, sum(c.x * c.x) AS nx, sum(m.m * m.m) AS nm
         FROM cells c JOIN mean m USING (input_id, dim) GROUP BY c.input_id, c.page_no)
SELECT input_id, page_no,
       round(CASE WHEN nx = 0 OR nm = 0 THEN 0.0 ELSE dot / (sqrt(nx) * sqrt(nm)) END, 6) AS cos FROM dots"""
    o["mean_vector"] = f"""WITH {F1},
cells AS (SELECT input_id, gold, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM f1)
SELECT input_id, gold, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS value FROM cells GROUP BY input_id, gold, dim"""
    o["distance_matrix"] = f"""WITH {F1}
SELECT a.input_id, a.page_no AS i, b.page_no AS j,
       round(CASE WHEN a.page_no = b.page_no THEN 0.0 ELSE {_d(a)} * list_distance(a.embedding, b.embedding)
             + {_d(1.0 - a)} * CAST(abs(a.page_no - b.page_no) AS DOUBLE) END, 6) AS dist
FROM f1 a JOIN f1 b ON a.input_id = b.input_id"""
    heat = []
    for al in (1.0, 0.9):
        heat.append(
            f"""SELECT a.input_id, {_d(al)} AS alpha, CAST(a.page_no // 10 AS INTEGER) AS bi, CAST(b.page_no // 10 AS INTEGER) AS bj,
       round(avg(CASE WHEN a.page_no = b.page_no THEN 0.0 ELSE {_d(al)} * list_distance(a.embedding, b.embedding)
             + {_d(1.0 - al)} * CAST(abs(a.page_no - b.page_no) AS DOUBLE) END), 6) AS avg_dist,
       round(min(CASE WHEN a.page_no = b.page_no THEN 0.0 ELSE {_d(al)} * list_distance(a.embedding, b.embedding)
             + {_d(1.0 - al)} * CAST(abs(a.page_no - b.page_no) AS DOUBLE) END), 6) AS min_dist,
       round(max(CASE WHEN a.page_no = b.page_no THEN 0.0 ELSE {_d(al)} * list_distance(a.embedding, b.embedding)
             + {_d(1.0 - al)} * CAST(abs(a.page_no - b.page_no) AS DOUBLE) END), 6) AS max_dist,
       CAST(count(*) AS BIGINT) AS cells
FROM f1 a JOIN f1 b ON a.input_id = b.input_id GROUP BY 1, 2, 3, 4"""
        )
    o["distance_heatmap"] = f"WITH {F1} " + " UNION ALL ".join(heat)
    o["cluster_average"] = cluster_sql(F1, "f1", a, DEFAULT_THRESHOLD, "average")
    o["cluster_complete"] = cluster_sql(F1, "f1", a, DEFAULT_THRESHOLD, "complete")
    o["cluster_single"] = cluster_sql(F1, "f1", 0.85, 1.36, "single")
    o["cluster_rounds"] = o["cluster_average"]
    o["cluster_components"] = o["cluster_single"]
    o.update(registry2())
    o["threshold_sweep"] = f"WITH RECURSIVE {F1},\n{grid_ctes('f1', [a], LEVELS, ['average'])}\nSELECT input_id, threshold, page_no, label FROM glabels"
    return o


# ---------------------------------------------------------------------------- text fixtures
F2 = r"""f2 AS (
  SELECT source AS input_id, doc_id, lang, coalesce(text, '') AS text,
         CAST(dense_rank() OVER (PARTITION BY source ORDER BY lang) - 1 AS INTEGER) AS gold,
         CAST(row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) - 1 AS INTEGER) AS page_no
  FROM documents),
f2w AS (SELECT input_id, page_no, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM f2),
f2c AS (SELECT input_id, page_no, CAST(CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS INTEGER) AS cell, count(*) AS n
        FROM f2w WHERE length(w) > 0 GROUP BY 1, 2, 3),
f2s AS (SELECT input_id, page_no, cell, n / sqrt(sum(n * n) OVER (PARTITION BY input_id, page_no)) AS value FROM f2c),
f2v AS (SELECT p.input_id, p.page_no, p.gold, p.text, list(coalesce(s.value, 0.0) ORDER BY c.cell) AS embedding
        FROM f2 p CROSS JOIN (SELECT range AS cell FROM range(64)) c
        LEFT JOIN f2s s ON s.input_id = p.input_id AND s.page_no = p.page_no AND s.cell = c.cell
        GROUP BY p.input_id, p.page_no, p.gold, p.text)"""

F3 = r"""f3l AS (
  SELECT input_id, stem, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM (
    SELECT CAST(doc_id AS VARCHAR) AS input_id, 'doc_' || CAST(doc_id AS VARCHAR) AS stem,
           string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
f3 AS (
  SELECT input_id, CAST(line_no // 3 AS INTEGER) AS page_no,
         printf('%s_page_%d.pdf', stem, CAST(line_no // 3 AS INTEGER) + 1) AS page_name,
         CAST(count(*) AS INTEGER) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM f3l GROUP BY input_id, stem, line_no // 3)"""

F4 = r"""f4 AS (
  SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1) AS input_id, page_id, url, html,
         CAST(row_number() OVER (PARTITION BY regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1) ORDER BY page_id) - 1 AS INTEGER) AS page_no
  FROM pages)"""


def docs_ctes(labels: str = "labels", pages: str = "f2v") -> str:
    """Documents (A5/W3) and their page texts (J3/J4) from a labels CTE."""
    return f"""docs AS (
  SELECT input_id, label, page_start, page_end, n_pages,
         CAST(row_number() OVER (PARTITION BY input_id ORDER BY page_start) - 1 AS INTEGER) AS document_no
  FROM (SELECT input_id, label, CAST(min(page_no) AS INTEGER) AS page_start, CAST(max(page_no) AS INTEGER) AS page_end,
               CAST(count(*) AS INTEGER) AS n_pages FROM {labels} GROUP BY input_id, label)),
doc_text AS (
  SELECT l.input_id, d.document_no, l.page_no, p.text
  FROM {labels} l JOIN docs d USING (input_id, label) JOIN {pages} p ON p.input_id = l.input_id AND p.page_no = l.page_no),
first_text AS (SELECT input_id, document_no, arg_min(text, page_no) AS text FROM doc_text GROUP BY 1, 2)"""


TOPICS = r"""tw AS (SELECT input_id, document_no, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM first_text),
tf AS (SELECT input_id, document_no, word, count(*) AS tf FROM tw WHERE length(word) > 1 GROUP BY 1, 2, 3),
dfr AS (SELECT input_id, word, count(*) AS df FROM tf GROUP BY 1, 2),
nd AS (SELECT input_id, count(*) AS n_docs FROM first_text GROUP BY 1),
sc AS (SELECT t.input_id, t.document_no, t.word,
              round(t.tf * (ln((1.0 + nd.n_docs) / (1.0 + dfr.df)) + 1.0), 9) AS score
       FROM tf t JOIN dfr USING (input_id, word) JOIN nd USING (input_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY input_id, document_no ORDER BY score DESC, word) AS r FROM sc),
topics AS (SELECT input_id, document_no, string_agg(word, '_' ORDER BY r) AS topic FROM rk WHERE r <= 2 GROUP BY 1, 2),
named AS (SELECT d.input_id, d.document_no, d.page_start, d.page_end, d.n_pages,
                 coalesce(t.topic, 'Cluster ' || CAST(d.document_no AS VARCHAR)) AS topic_name
          FROM docs d LEFT JOIN topics t USING (input_id, document_no))"""


def scores_ctes(labels: str, gold: str, keys: list[str]) -> str:
    """Contingency (A8), ARI (A9) and NMI (A10) sums, ending in ``scored(keys..., ari, nmi)``."""
    k = ", ".join(keys)
    return f"""cont AS (SELECT {', '.join('l.' + x for x in keys)}, g.gold, l.label, count(*) AS n
         FROM {labels} l JOIN {gold} g ON g.input_id = l.input_id AND g.page_no = l.page_no GROUP BY ALL),
ctot AS (SELECT {k}, sum(CAST(n AS DOUBLE)) AS tot, sum(CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) - 1.0) / 2.0) AS s FROM cont GROUP BY ALL),
cai AS (SELECT {k}, gold, sum(CAST(n AS DOUBLE)) AS ai FROM cont GROUP BY ALL),
cbj AS (SELECT {k}, label, sum(CAST(n AS DOUBLE)) AS bj FROM cont GROUP BY ALL),
caa AS (SELECT {k}, sum(ai * (ai - 1.0) / 2.0) AS a, count(*) AS kg FROM cai GROUP BY ALL),
cbb AS (SELECT {k}, sum(bj * (bj - 1.0) / 2.0) AS b, count(*) AS kp FROM cbj GROUP BY ALL),
cmi AS (SELECT {', '.join('c.' + x for x in keys)}, sum((CAST(c.n AS DOUBLE) / t.tot) * ln(t.tot * c.n / (a.ai * b.bj))) AS mi
        FROM cont c JOIN cai a USING ({k}, gold) JOIN cbj b USING ({k}, label) JOIN ctot t USING ({k}) GROUP BY ALL),
chg AS (SELECT {k}, -sum((ai / tot) * ln(ai / tot)) AS hg FROM cai JOIN ctot USING ({k}) GROUP BY ALL),
chp AS (SELECT {k}, -sum((bj / tot) * ln(bj / tot)) AS hp FROM cbj JOIN ctot USING ({k}) GROUP BY ALL),
scored AS (
  SELECT {k},
         CASE WHEN tot * (tot - 1.0) / 2.0 = 0 THEN 1.0
              WHEN (a + b) / 2.0 - a * b / (tot * (tot - 1.0) / 2.0) = 0 THEN 1.0
              ELSE (s - a * b / (tot * (tot - 1.0) / 2.0)) / ((a + b) / 2.0 - a * b / (tot * (tot - 1.0) / 2.0)) END AS ari,
         CASE WHEN kg = 1 AND kp = 1 THEN 1.0 WHEN greatest(mi, 0.0) < 1e-15 THEN 0.0
              ELSE greatest(mi, 0.0) / ((hg + hp) / 2.0) END AS nmi
  FROM ctot JOIN caa USING ({k}) JOIN cbb USING ({k}) JOIN cmi USING ({k}) JOIN chg USING ({k}) JOIN chp USING ({k}))"""


def grid_ctes(src: str, alphas, thresholds, linkages, vec: str = "embedding") -> str:
    """Labels of every (alpha, linkage, threshold, input) from one recursive merge per
    (alpha, linkage, input), recording merge heights below the largest threshold.
    Ends in ``glabels(alpha, linkage, threshold, input_id, page_no, label)``."""
    al = ", ".join(f"({float(a)!r})" for a in alphas)
    lk = ", ".join(f"('{x}')" for x in linkages)
    th = ", ".join(f"({float(t)!r})" for t in thresholds)
    top = max(float(t) for t in thresholds)
    return f"""galpha(alpha) AS (SELECT CAST(col0 AS DOUBLE) FROM (VALUES {al})),
glink(linkage) AS (SELECT col0 FROM (VALUES {lk})),
gthr(threshold) AS (SELECT CAST(col0 AS DOUBLE) FROM (VALUES {th})),
gbase AS (
  SELECT g.alpha, a.input_id, a.page_no AS i, b.page_no AS j,
         round(g.alpha * list_distance(a.{vec}, b.{vec}) + (1.0 - g.alpha) * CAST(abs(a.page_no - b.page_no) AS DOUBLE), 9) AS d
  FROM {src} a JOIN {src} b ON a.input_id = b.input_id AND a.page_no < b.page_no CROSS JOIN galpha g),
gsteps(step, alpha, linkage, input_id, page_no, cl, h) AS (
  SELECT 0, g.alpha, l.linkage, p.input_id, p.page_no, p.page_no, CAST(NULL AS DOUBLE)
  FROM {src} p CROSS JOIN galpha g CROSS JOIN glink l
  UNION ALL
  SELECT s.step + 1, s.alpha, s.linkage, s.input_id, s.page_no, CASE WHEN s.cl = m.cb THEN m.ca ELSE s.cl END, m.v
  FROM gsteps s JOIN (
    SELECT alpha, linkage, input_id, arg_min(ca, k) AS ca, arg_min(cb, k) AS cb, min(v) AS v FROM (
      SELECT x.alpha, x.linkage, b.input_id, least(x.cl, y.cl) AS ca, greatest(x.cl, y.cl) AS cb,
             round(CASE x.linkage WHEN 'average' THEN avg(b.d) WHEN 'complete' THEN max(b.d) ELSE min(b.d) END, 9) AS v,
             (round(CASE x.linkage WHEN 'average' THEN avg(b.d) WHEN 'complete' THEN max(b.d) ELSE min(b.d) END, 9),
              least(x.cl, y.cl), greatest(x.cl, y.cl)) AS k
      FROM gbase b
      JOIN gsteps x ON x.alpha = b.alpha AND x.input_id = b.input_id AND x.page_no = b.i
      JOIN gsteps y ON y.alpha = b.alpha AND y.linkage = x.linkage AND y.input_id = b.input_id AND y.page_no = b.j
      WHERE x.cl <> y.cl
      GROUP BY x.alpha, x.linkage, b.input_id, least(x.cl, y.cl), greatest(x.cl, y.cl)
    ) WHERE v < {_d(top)} GROUP BY alpha, linkage, input_id
  ) m ON s.alpha = m.alpha AND s.linkage = m.linkage AND s.input_id = m.input_id
),
glabels AS (
  SELECT s.alpha, s.linkage, t.threshold, s.input_id, s.page_no, CAST(arg_max(s.cl, s.step) AS INTEGER) AS label
  FROM gsteps s JOIN gthr t ON s.step = 0 OR s.h < t.threshold
  GROUP BY s.alpha, s.linkage, t.threshold, s.input_id, s.page_no)"""


def grid_pos_cte(alphas, thresholds, linkages) -> str:
    rows = []
    for ia, a in enumerate(alphas):
        for it, t in enumerate(thresholds):
            for il, lk in enumerate(linkages):
                rows.append(f"({float(a)!r}, {float(t)!r}, '{lk}', {ia * len(thresholds) * len(linkages) + it * len(linkages) + il})")
    return f"""gpos(alpha, threshold, linkage, grid_pos) AS (
  SELECT CAST(col0 AS DOUBLE), CAST(col1 AS DOUBLE), col2, CAST(col3 AS INTEGER) FROM (VALUES {', '.join(rows)}))"""


def registry2() -> dict[str, str]:
    from ..constants import ALPHA_GRID, LINKAGE_GRID, THRESHOLD_GRID

    a, t = DEFAULT_ALPHA, DEFAULT_THRESHOLD
    o: dict[str, str] = {}
    alike = f"""WITH {F2}, {_pairs_cte(1.0, 'f2v')},
classes AS (SELECT input_id, page_no, CAST(min(page_no) OVER (PARTITION BY input_id, embedding) AS INTEGER) AS class_page FROM f2v)"""
    o["near_pairs"] = alike + """
SELECT b.input_id, b.i, b.j, round(b.d, 6) AS dist FROM base b
JOIN classes x ON x.input_id = b.input_id AND x.page_no = b.i AND x.class_page = b.i
JOIN classes y ON y.input_id = b.input_id AND y.page_no = b.j AND y.class_page = b.j WHERE b.d < 0.25"""
    o["near_links"] = alike + """,
ends AS (SELECT input_id, unnest([i, j]) AS page_no FROM base WHERE d < 0.25),
links AS (SELECT input_id, page_no, count(*) AS n FROM ends GROUP BY ALL)
SELECT c.input_id, c.page_no, c.class_page, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM classes c LEFT JOIN links l ON l.input_id = c.input_id AND l.page_no = c.page_no"""
    o["text_vectors"] = f"WITH {F2} SELECT input_id, page_no, cell, round(value, 6) AS value FROM f2s"
    o["embed_missing"] = f"""WITH {F2}
SELECT s.input_id, s.page_no, md5(p.text) AS text_hash, s.cell, round(s.value, 6) AS value
FROM f2s s JOIN f2 p ON p.input_id = s.input_id AND p.page_no = s.page_no"""
    o["short_segments"] = f"""WITH {F2}
SELECT input_id, page_no, CAST(len(string_split(text, chr(10))) AS INTEGER) AS segments,
       CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 1)) AS INTEGER) AS kept FROM f2"""
    o["page_text"] = f"""WITH {F4}
SELECT input_id, page_no, page_id,
       trim(regexp_replace(regexp_replace(regexp_replace(html,
            '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text
FROM f4"""
    o["file_scan"] = "SELECT page_id, url FROM pages"
    o["page_explode"] = f"WITH {F3} SELECT input_id, page_no, page_name, n_lines, md5(text) AS text_md5 FROM f3"
    o["name_parts"] = f"""WITH {F3}
SELECT input_id, page_no, page_name,
       regexp_replace(page_name, '\\.[^.]*$', '') AS stem,
       regexp_replace(page_name, '\\.pdf$', '.txt') AS text_name,
       'doc_' || input_id || '_embeddings' AS vectors_name
FROM f3"""
    o["missing_pages"] = f"""WITH {F3},
req AS (SELECT CAST(doc_id AS VARCHAR) AS input_id,
               CAST(unnest(range(CAST(greatest(ceil(n_chars / 1000.0), 1) AS BIGINT))) AS INTEGER) AS page_no
        FROM documents)
SELECT r.input_id, r.page_no FROM req r
WHERE NOT EXISTS (SELECT 1 FROM f3 p WHERE p.input_id = r.input_id AND p.page_no = r.page_no)"""
    o["missing_inputs"] = """SELECT DISTINCT CAST(d.doc_id AS VARCHAR) AS input_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)"""
    fold = f"""WITH RECURSIVE {F2},
fold(input_id, page_no, s, label) AS (
  SELECT input_id, page_no, embedding, 0 FROM f2v WHERE page_no = 0
  UNION ALL
  SELECT q.input_id, q.page_no,
         CASE WHEN q.sim < {_d(1.0 - 0.4)} THEN q.embedding ELSE list_transform(list_zip(q.s, q.embedding), lambda z: z[1] + z[2]) END,
         q.label + CASE WHEN q.sim < {_d(1.0 - 0.4)} THEN 1 ELSE 0 END
  FROM (
    SELECT v.input_id, v.page_no, v.embedding, f.s, f.label,
           CASE WHEN list_inner_product(v.embedding, v.embedding) = 0 OR list_inner_product(f.s, f.s) = 0 THEN 0.0
                ELSE list_inner_product(v.embedding, f.s) / (sqrt(list_inner_product(v.embedding, v.embedding)) * sqrt(list_inner_product(f.s, f.s))) END AS sim
    FROM fold f JOIN f2v v ON v.input_id = f.input_id AND v.page_no = f.page_no + 1) q
)
SELECT input_id, page_no, CAST(label AS INTEGER) AS label FROM fold"""
    o["boundary_detection"] = fold
    o["boundary_chunked"] = fold
    o["gap_split"] = """WITH sl AS (
  SELECT CAST(vec_id // 50 AS VARCHAR) AS input_id, CAST(label AS INTEGER) AS label,
         CAST(row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) - 1 AS INTEGER) AS page_no FROM embeddings),
heads AS (  -- a member with an earlier member but none within 2 pages before it opens a gap > 2
  SELECT b.input_id, b.label, min(b.page_no) AS cut FROM sl b
  WHERE EXISTS (SELECT 1 FROM sl d WHERE d.input_id = b.input_id AND d.label = b.label AND d.page_no < b.page_no)
    AND NOT EXISTS (SELECT 1 FROM sl c WHERE c.input_id = b.input_id AND c.label = b.label
                    AND c.page_no BETWEEN b.page_no - 2 AND b.page_no - 1)
  GROUP BY b.input_id, b.label),
numbered AS (
  SELECT h.input_id, h.label, h.cut,
         (SELECT max(label) FROM sl x WHERE x.input_id = h.input_id)
         + (SELECT count(*) FROM heads h2 WHERE h2.input_id = h.input_id AND h2.label <= h.label) AS new_label
  FROM heads h)
SELECT s.input_id, s.page_no,
       CAST(CASE WHEN n.cut IS NOT NULL AND s.page_no >= n.cut THEN n.new_label ELSE s.label END AS INTEGER) AS label
FROM sl s LEFT JOIN numbered n ON n.input_id = s.input_id AND n.label = s.label"""
    f2_docs = f"WITH RECURSIVE {F2},\n{cluster_ctes('f2v', a, t, 'average')},\n{docs_ctes()}"
    o["documents_from_labels"] = f2_docs + """
SELECT input_id, document_no, md5(input_id || ':' || CAST(page_start AS VARCHAR)) AS document_id,
       'Cluster ' || CAST(document_no AS VARCHAR) AS topic_name, page_start, page_end, n_pages FROM docs"""
    f1_complete = f"WITH RECURSIVE {F1},\n{cluster_ctes('f1', a, t, 'complete')}"
    o["renumber_documents"] = f1_complete + """,
docs AS (SELECT input_id, label, CAST(min(page_no) AS INTEGER) AS page_start FROM labels GROUP BY 1, 2)
SELECT input_id, CAST(row_number() OVER (PARTITION BY input_id ORDER BY page_start) - 1 AS INTEGER) AS document_no, page_start FROM docs"""
    o["label_pages"] = f1_complete + "\nSELECT l.input_id, l.page_no, l.label, f.gold FROM labels l JOIN f1 f USING (input_id, page_no)"
    o["document_text"] = f2_docs + "\nSELECT input_id, document_no, page_no, md5(text) AS text_md5 FROM doc_text"
    o["first_page_text"] = f2_docs + "\nSELECT input_id, document_no, md5(text) AS text_md5 FROM first_text"
    o["sample_pages"] = f2_docs + """,
smp AS (SELECT *, row_number() OVER (PARTITION BY input_id, document_no
                                    ORDER BY md5('quire:' || input_id || ':' || CAST(page_no AS VARCHAR)), page_no) AS r FROM doc_text)
SELECT input_id, document_no, CAST(count(*) AS INTEGER) AS n_sampled, md5(string_agg(text, ' ' ORDER BY r)) AS text_md5
FROM smp WHERE r <= 5 GROUP BY 1, 2"""
    o["concat_pages"] = f"""WITH {F2}
SELECT input_id, gold, CAST(length(string_agg(text, ' ' ORDER BY page_no)) AS INTEGER) AS n_chars,
       md5(string_agg(text, ' ' ORDER BY page_no)) AS text_md5 FROM f2 GROUP BY 1, 2"""
    o["reassemble_documents"] = f2_docs + """
SELECT input_id, document_no, CAST(length(string_agg(text, chr(10) ORDER BY page_no)) AS INTEGER) AS n_chars,
       md5(string_agg(text, chr(10) ORDER BY page_no)) AS text_md5 FROM doc_text GROUP BY 1, 2"""
    o["document_topics"] = f2_docs + f",\n{TOPICS}\nSELECT input_id, document_no, topic FROM topics"
    o["assign_topics"] = f2_docs + f",\n{TOPICS}\nSELECT input_id, document_no, topic_name FROM named"
    o["output_manifest"] = f2_docs + f""",\n{TOPICS},
names AS (SELECT input_id, document_no, printf('document_%d_%s', document_no, topic_name) AS name FROM named)
SELECT input_id, name, CAST(row_number() OVER (PARTITION BY input_id ORDER BY name, document_no) - 1 AS INTEGER) AS position FROM names"""
    o["split_summary"] = f2_docs + f""",\n{TOPICS}
SELECT input_id, document_no, printf('document_%d_%s', document_no, topic_name) AS name, page_start || '-' || page_end AS pages_from_to,
       CAST(count(*) OVER (PARTITION BY input_id) AS INTEGER) AS documents, CAST(sum(n_pages) OVER (PARTITION BY input_id) AS BIGINT) AS pages
FROM named"""
    o["split_levels"] = f"WITH RECURSIVE {F2},\n{grid_ctes('f2v', [a], LEVELS, ['average'])}" + """
SELECT input_id, threshold, page_no, label FROM glabels"""
    o["gold_labels"] = f"""WITH {F1},
ranges AS (SELECT input_id, gold, min(page_no) AS page_start, max(page_no) + 2 AS page_end FROM f1 GROUP BY 1, 2 HAVING gold <> 2)
SELECT p.input_id, p.page_no, CAST(coalesce(max(r.gold), 0) AS INTEGER) AS gold
FROM f1 p LEFT JOIN ranges r ON r.input_id = p.input_id AND p.page_no BETWEEN r.page_start AND r.page_end GROUP BY 1, 2"""
    f2_avg = f"WITH RECURSIVE {F2},\n{cluster_ctes('f2v', a, t, 'average')}"
    o["contingency"] = f2_avg + f",\n{scores_ctes('labels', 'f2v', ['input_id'])}\nSELECT input_id, gold, label, CAST(n AS BIGINT) AS n FROM cont"
    o["adjusted_rand"] = f2_avg + f",\n{scores_ctes('labels', 'f2v', ['input_id'])}\nSELECT input_id, round(ari, 6) AS ari FROM scored"
    o["nmi"] = f2_avg + f",\n{scores_ctes('labels', 'f2v', ['input_id'])}\nSELECT input_id, round(nmi, 6) AS nmi FROM scored"
    o["param_grid"] = f"""WITH {F2}, {grid_pos_cte(ALPHA_GRID, THRESHOLD_GRID, LINKAGE_GRID)},
n AS (SELECT input_id, CAST(count(*) AS INTEGER) AS n_pages FROM f2 GROUP BY 1)
SELECT n.input_id, n.n_pages, g.alpha, g.threshold, g.linkage, g.grid_pos,
       CASE WHEN g.alpha < 1.0 THEN CAST(least(ceil(g.threshold / (1.0 - g.alpha)), n.n_pages) AS INTEGER) END AS band_pages
FROM n CROSS JOIN gpos g"""
    search = (
        f"WITH RECURSIVE {F2},\n{grid_ctes('f2v', ALPHA_GRID, THRESHOLD_GRID, LINKAGE_GRID)},\n"
        f"{scores_ctes('glabels', 'f2v', ['input_id', 'alpha', 'threshold', 'linkage'])},\n"
        f"{grid_pos_cte(ALPHA_GRID, THRESHOLD_GRID, LINKAGE_GRID)}"
    )
    o["grid_search"] = search + """
SELECT s.input_id, s.alpha, s.threshold, s.linkage, g.grid_pos, round(s.ari, 6) AS ari, round(s.nmi, 6) AS nmi
FROM scored s JOIN gpos g USING (alpha, threshold, linkage)"""
    o["best_params"] = search + """,
ranked AS (SELECT s.*, g.grid_pos FROM scored s JOIN gpos g USING (alpha, threshold, linkage))
SELECT input_id, arg_min(alpha, (-round(ari, 9), grid_pos)) AS alpha, arg_min(threshold, (-round(ari, 9), grid_pos)) AS threshold,
       arg_min(linkage, (-round(ari, 9), grid_pos)) AS linkage, round(arg_min(ari, (-round(ari, 9), grid_pos)), 6) AS ari,
       round(arg_min(nmi, (-round(ari, 9), grid_pos)), 6) AS nmi
FROM ranked GROUP BY input_id"""
    o["split_documents"] = f2_docs + f""",\n{TOPICS}
SELECT input_id, document_no, md5(input_id || ':' || CAST(page_start AS VARCHAR)) AS document_id, topic_name,
       page_start, page_end, n_pages FROM named"""
    o["stream_boundaries"] = o["boundary_detection"]
    o["text_scan"] = f"WITH {F3} SELECT input_id, page_no, md5(text) AS text_md5 FROM f3"
    o["write_documents"] = f2_docs + f""",\n{TOPICS}
SELECT n.input_id, n.document_no, b.page_no, printf('document_%d_%s', n.document_no, n.topic_name) AS name, md5(b.text) AS text_md5
FROM named n JOIN doc_text b USING (input_id, document_no)"""
    o["stream_intake"] = f2_docs + f""",\n{TOPICS}
SELECT input_id, document_no, md5(input_id || ':' || CAST(page_start AS VARCHAR)) AS document_id, topic_name,
       page_start, page_end, n_pages, n_pages AS n_written FROM named"""
    return o
