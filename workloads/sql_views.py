"""The input views and shared intermediate results in DuckDB SQL.

``sql(tail)`` prefixes a statement with the common table expressions it names.
"""

from __future__ import annotations

import re

from pageloom.functions import metrics

PK = "doc_id, page_index"

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def sql(tail: str) -> str:
    """The statement with every named CTE it needs, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(tail)
    if not order:
        return tail
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in order)
    return f"WITH {heads}\n{tail.strip()}"


# --- words on pages -----------------------------------------------------------

cte("v_word", r"""
SELECT doc_id, unnest(ws) AS text, unnest(range(len(ws))) AS run_ord
FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents)""")

cte("v_run", """
SELECT doc_id, CAST(run_ord // 576 AS INTEGER) AS page_index, run_ord, text,
       x0 + CASE WHEN doc_id % 4 = 0 AND run_ord % 12 >= 6 THEN 40.0::DOUBLE ELSE 0 END AS x,
       760.0::DOUBLE - 14 * r - 10 * (r // 8) + 0.5::DOUBLE * ((run_ord % 12) % 2) AS y,
       5.0::DOUBLE * length(text) AS w, 10.0::DOUBLE AS h,
       font_name, 10.0::DOUBLE AS size,
       (r % 8 = 0 OR regexp_matches(font_name, '(?i)bold|black|heavy|semibold|[6-9]00')) AS bold,
       regexp_matches(font_name, '(?i)italic|oblique') AS italic
FROM (SELECT *, (run_ord // 12) % 48 AS r,
        40.0::DOUBLE + coalesce(sum(5.0::DOUBLE * length(text) + CASE WHEN doc_id % 5 = 0 AND run_ord % 7 = 3 THEN 0 ELSE 3 END)
          OVER (PARTITION BY doc_id, run_ord // 12 ORDER BY run_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0,
        ['Helvetica', 'ABCDEE+Cambria', 'CourierNew', 'TimesNewRomanPS-ItalicMT', 'Unknown-700'][CAST(doc_id % 5 AS INTEGER) + 1] AS font_name
      FROM v_word)""")

cte("v_page", """
SELECT doc_id, CAST(unnest(range((len(regexp_extract_all(text, '\\S+')) + 575) // 576)) AS INTEGER) AS page_index
FROM documents""".replace("\\\\", "\\"))

# --- rows, lines ----------------------------------------------------------------

cte("v_row", f"""
SELECT *, sum(opens) OVER (PARTITION BY {PK} ORDER BY y DESC, x, run_ord ROWS UNBOUNDED PRECEDING) - 1 AS row_id
FROM (SELECT *, CASE WHEN lag(y) OVER w IS NULL OR lag(y) OVER w - y > greatest(1.5, 0.18 * size) THEN 1 ELSE 0 END AS opens
      FROM v_run WINDOW w AS (PARTITION BY {PK} ORDER BY y DESC, x, run_ord))""")

cte("v_placed", f"""
SELECT *, sum(cut) OVER w AS seg, row_number() OVER w AS seg_ord,
       cut = 0 AND gap > greatest(0.75, 0.08 * size) AND NOT regexp_matches(text, '^[,.;:!?%)}}\\]]')
         AND right(ptext, 1) NOT IN ('(', '[', '{{', '/') AS spaced
FROM (SELECT *, CASE WHEN gap > greatest(18, 1.75 * size)
        OR (regexp_matches(ptext, '^[0-9.,/-]{{1,6}}$') AND regexp_matches(text, '^[0-9.,/-]{{1,6}}$') AND gap > greatest(3, 0.4 * size))
        THEN 1 ELSE 0 END AS cut
      FROM (SELECT *, x - lag(x + w) OVER w2 AS gap, lag(text) OVER w2 AS ptext
            FROM v_row WINDOW w2 AS (PARTITION BY {PK}, row_id ORDER BY x, y DESC, run_ord)))
WINDOW w AS (PARTITION BY {PK}, row_id ORDER BY x, y DESC, run_ord ROWS UNBOUNDED PRECEDING)""")

cte("v_line0", f"""
SELECT {PK}, row_id, seg, string_agg(CASE WHEN spaced THEN ' ' ELSE '' END || text, '' ORDER BY seg_ord) AS text,
       min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, avg(y) AS baseline_y,
       arg_max(font_name, length(text) * 1000 - seg_ord) AS font_name, arg_max(size, length(text) * 1000 - seg_ord) AS size,
       arg_max(bold, length(text) * 1000 - seg_ord) AS bold, arg_max(italic, length(text) * 1000 - seg_ord) AS italic,
       count(*) AS n_runs, min(run_ord) AS first_run_ord
FROM v_placed GROUP BY ALL""")

cte("v_line", f"""
SELECT *, row_number() OVER (PARTITION BY {PK} ORDER BY baseline_y DESC, x, row_id, seg) AS line_ord FROM v_line0""")

cte("v_page_text", f"""
SELECT {PK}, string_agg(text, chr(10) ORDER BY line_ord) AS text, count(*) AS n_lines FROM v_line GROUP BY ALL""")

cte("v_doc_text", """
SELECT doc_id, count(*) AS n_pages, CAST(sum(n_lines) AS BIGINT) AS n_lines,
       string_agg('[Page ' || (page_index + 1) || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY page_index) AS whole
FROM v_page_text GROUP BY doc_id""")

# --- paragraph blocks, window form -------------------------------------------------

FAMILY = """CASE WHEN regexp_matches({0}, '(?i)sans[-_\\s]*serif') THEN 'sans'
  WHEN regexp_matches({0}, '(?i)times|georgia|serif|cambria|garamond|minion|book[-_\\s]*antiqua|palatino|baskerville|bodoni|constantia|merriweather') THEN 'serif'
  WHEN regexp_matches({0}, '(?i)courier|mono|consolas') THEN 'mono' ELSE 'sans' END"""

cte("v_col", f"""
SELECT *, sum(new_col) OVER (PARTITION BY {PK} ORDER BY x, line_ord ROWS UNBOUNDED PRECEDING) AS col
FROM (SELECT *, regexp_matches(text, '^[0-9.,/-]{{1,6}}$') AS num, length(text) >= 24 OR n_runs >= 3 AS para,
        {FAMILY.format('font_name')} || bold || italic AS sk,
        CASE WHEN lag(x) OVER w IS NULL OR x - lag(x) OVER w > greatest(9, size) THEN 1 ELSE 0 END AS new_col
      FROM v_line WINDOW w AS (PARTITION BY {PK} ORDER BY x, line_ord))""")

cte("v_chain", f"""
SELECT *, sum(brk) OVER (PARTITION BY {PK}, col ORDER BY baseline_y DESC, x, line_ord ROWS UNBOUNDED PRECEDING) AS chain
FROM (SELECT *, CASE WHEN NOT pnum AND NOT num AND gap > 0.5 AND gap <= 1.85 * greatest(psize, size)
          AND abs(psize - size) <= greatest(1.5, 0.22 * greatest(psize, size)) AND psk = sk AND (ppara OR para)
        THEN 0 ELSE 1 END AS brk
      FROM (SELECT *, lag(baseline_y) OVER w - baseline_y AS gap, lag(size) OVER w AS psize, lag(num) OVER w AS pnum,
              lag(sk) OVER w AS psk, lag(para) OVER w AS ppara
            FROM v_col WINDOW w AS (PARTITION BY {PK}, col ORDER BY baseline_y DESC, x, line_ord)))""")

cte("v_window_line", f"""
SELECT *, min(line_ord) OVER (PARTITION BY {PK}, col, blk) AS block_ord
FROM (SELECT *, sum(CASE WHEN brk = 1 OR abs(gap - earlier) > greatest(2, 0.35 * earlier) THEN 1 ELSE 0 END)
          OVER (PARTITION BY {PK}, col ORDER BY baseline_y DESC, x, line_ord ROWS UNBOUNDED PRECEDING) AS blk
      FROM (SELECT *, quantile_cont(CASE WHEN brk = 0 THEN gap END, 0.5) OVER (
                PARTITION BY {PK}, col, chain ORDER BY baseline_y DESC, x, line_ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
            FROM v_chain))""")

# The open paragraphs of a page as a fold over its lines in reading order.
EXACT_SQL = """
SELECT doc_id, page_index, unnest(range(1, len(f.r) + 1)) AS line_ord, unnest(f.r) AS block_ord FROM (
 SELECT doc_id, page_index, list_reduce(list_prepend({'g': []::G[], 'r': []::BIGINT[]}, list({'g': [
     {'id': 0::BIGINT, 'y': baseline_y, 'x': x, 'w': w, 's': size, 'sk': sk, 'para': para, 'num': num, 'gaps': []::DOUBLE[]}], 'r': []::BIGINT[]} ORDER BY line_ord)),
   lambda a, b: CASE WHEN BEST IS NULL
     THEN {'g': list_append(a.g, {'id': len(a.g) + 1, 'y': L.y, 'x': L.x, 'w': L.w, 's': L.s, 'sk': L.sk, 'para': L.para, 'num': L.num, 'gaps': []::DOUBLE[]}),
           'r': list_append(a.r, len(a.g) + 1)}
     ELSE {'g': list_transform(a.g, lambda q: CASE WHEN q.id = BEST
             THEN {'id': q.id, 'y': L.y, 'x': L.x, 'w': L.w, 's': L.s, 'sk': L.sk, 'para': L.para, 'num': L.num, 'gaps': list_append(q.gaps, q.y - L.y)} ELSE q END),
           'r': list_append(a.r, BEST)} END) AS f
 FROM (SELECT *, FAMILY || bold || italic AS sk, regexp_matches(text, '^[0-9.,/-]{1,6}$') AS num, length(text) >= 24 OR n_runs >= 3 AS para FROM v_line)
 GROUP BY doc_id, page_index)"""
_G = "STRUCT(id BIGINT, y DOUBLE, x DOUBLE, w DOUBLE, s DOUBLE, sk VARCHAR, para BOOLEAN, num BOOLEAN, gaps DOUBLE[])"
_BEST = """(list_sort(list_transform(list_filter(a.g, lambda c: NOT c.num AND NOT L.num AND c.y - L.y > 0.5 AND c.y - L.y <= 1.85 * greatest(c.s, L.s)
  AND abs(c.s - L.s) <= greatest(1.5, 0.22 * greatest(c.s, L.s)) AND c.sk = L.sk AND (c.para OR L.para)
  AND NOT (abs(c.x - L.x) > greatest(9, greatest(c.s, L.s)) AND greatest(0, least(c.x + c.w, L.x + L.w) - greatest(c.x, L.x)) / greatest(1, least(c.w, L.w)) < 0.7)
  AND (len(c.gaps) = 0 OR abs(c.y - L.y - list_aggregate(c.gaps, 'median')) <= greatest(2, 0.35 * list_aggregate(c.gaps, 'median')))),
  lambda c: {'d': abs(c.x - L.x), 'id': c.id}))[1].id)"""
EXACT_SQL = (EXACT_SQL.replace("BEST", _BEST).replace("L.", "b.g[1].").replace("::G[]", f"::{_G}[]")
             .replace("FAMILY", FAMILY.format("font_name")))

cte("v_block_line", f"SELECT l.*, e.block_ord FROM v_line l JOIN ({EXACT_SQL}) e USING (doc_id, page_index, line_ord)")

cte("v_block", f"""
SELECT {PK}, block_ord, string_agg(text, chr(10) ORDER BY line_ord) AS text, min(x) AS x, min(y) AS y,
       max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, max(baseline_y) AS top_baseline_y,
       coalesce(nullif(median(g), 0), 1.2 * arg_min(size, line_ord)) AS line_height_pt, count(*) AS n_lines,
       arg_min(font_name, line_ord) AS font_name, arg_min(size, line_ord) AS size,
       arg_min(bold, line_ord) AS bold, arg_min(italic, line_ord) AS italic
FROM (SELECT *, lag(baseline_y) OVER (PARTITION BY {PK}, block_ord ORDER BY line_ord) - baseline_y AS g FROM v_block_line)
GROUP BY ALL""")

# --- image boxes and bullets --------------------------------------------------------

cte("v_region", f"""
SELECT {PK}, run_ord * 2 AS region_id, x, y - 20 AS y, 280.0::DOUBLE AS w, 60.0::DOUBLE AS h FROM v_run WHERE run_ord % 12 = 0
UNION ALL
SELECT {PK}, run_ord * 2 + 1, x - 11, y + 1.5::DOUBLE, 3.0::DOUBLE, 3.0::DOUBLE FROM v_run WHERE run_ord % 36 = 0""")

cte("v_candidate", f"""
SELECT l.doc_id, l.page_index, l.block_ord, l.line_ord, r.region_id, r.x AS m_x, r.y AS m_y, r.w AS m_w, r.h AS m_h,
       abs(r.y + r.h / 2 - (l.baseline_y + l.size * 0.34)) + (l.x - (r.x + r.w)) * 0.05 AS distance
FROM v_block_line l JOIN v_region r ON l.doc_id = r.doc_id AND l.page_index = r.page_index
 AND greatest(r.w, r.h) BETWEEN 1 AND least(7, 0.85 * l.size) AND r.w / greatest(0.001, r.h) BETWEEN 0.65 AND 1.55
 AND l.x - (r.x + r.w) BETWEEN 0.5 AND 16
 AND abs(r.y + r.h / 2 - (l.baseline_y + l.size * 0.34)) <= greatest(1.5, 0.34 * l.size)""")

# With one square per third row a line and a square meet at most once per row of text,
# so the greedy claim is the nearest pair from both sides.
cte("v_marker", f"""
SELECT * FROM v_candidate
QUALIFY row_number() OVER (PARTITION BY {PK}, block_ord, line_ord ORDER BY distance, region_id) = 1
    AND row_number() OVER (PARTITION BY {PK}, block_ord, region_id ORDER BY line_ord) = 1""")

cte("v_item_line", f"""
SELECT l.*, m.m_x, m.m_y, m.m_w, m.m_h,
       count(m.region_id) OVER (PARTITION BY l.doc_id, l.page_index, l.block_ord ORDER BY l.line_ord ROWS UNBOUNDED PRECEDING) AS item_ord
FROM v_block_line l LEFT JOIN v_marker m USING (doc_id, page_index, block_ord, line_ord)""")

cte("v_item", f"""
SELECT {PK}, block_ord, item_ord, regexp_replace(string_agg(trim(text), ' ' ORDER BY line_ord), '\\s+', ' ', 'g') AS text,
       arg_min(baseline_y, line_ord) AS baseline_y, arg_min(x, line_ord) AS text_x, count(*) AS n_lines,
       max(m_x) AS m_x, max(m_y) AS m_y, max(m_w) AS m_w, max(m_h) AS m_h,
       min(x) AS item_x, min(y) AS item_y, max(x + w) AS item_r, max(y + h) AS item_t
FROM v_item_line WHERE item_ord > 0 GROUP BY ALL""")

cte("v_list", f"""
SELECT {PK}, block_ord, count(*) AS n_items, CAST(sum(n_lines) AS BIGINT) AS n_lines, median(m_x) AS bullet_x, median(text_x) AS text_x,
       median(greatest(m_w, m_h)) AS bullet_size_pt, any_value(line_height_pt) AS line_height_pt,
       coalesce(median(sp), 0) AS item_spacing_pt,
       min(item_x) AS list_x, min(item_y) AS list_y, max(item_r) - min(item_x) AS list_w, max(item_t) - min(item_y) AS list_h,
       least(min(item_x), min(m_x)) AS cover_x, least(min(item_y), min(m_y)) AS cover_y,
       greatest(max(item_r), max(m_x + m_w)) - least(min(item_x), min(m_x)) AS cover_w,
       greatest(max(item_t), max(m_y + m_h)) - least(min(item_y), min(m_y)) AS cover_h,
       string_agg('• ' || text, chr(10) ORDER BY item_ord) AS editor_text
FROM (SELECT i.*, b.line_height_pt,
        greatest(0, i.baseline_y - lead(i.baseline_y) OVER w - i.n_lines * b.line_height_pt)
          * CASE WHEN lead(i.item_ord) OVER w IS NULL THEN NULL ELSE 1 END AS sp
      FROM v_item i JOIN v_block b USING (doc_id, page_index, block_ord)
      WINDOW w AS (PARTITION BY doc_id, page_index, block_ord ORDER BY item_ord))
GROUP BY ALL HAVING count(*) >= 2""".replace("i.doc_id", "doc_id"))

# --- pixels --------------------------------------------------------------------------

cte("v_pixel", """
SELECT image_id, CAST(idx % 48 AS INTEGER) AS px, CAST(idx // 48 AS INTEGER) AS py,
       CAST(CASE kind WHEN 0 THEN n1 WHEN 1 THEN tone ELSE CASE WHEN idx % 11 = 0 THEN n1 ELSE 200 END END AS INTEGER) AS r,
       CAST(CASE kind WHEN 0 THEN n3 WHEN 1 THEN tone ELSE CASE WHEN idx % 11 = 0 THEN n3 ELSE 200 END END AS INTEGER) AS g,
       CAST(CASE kind WHEN 0 THEN n7 WHEN 1 THEN tone ELSE CASE WHEN idx % 11 = 0 THEN n7 ELSE 200 END END AS INTEGER) AS b,
       CASE WHEN image_id % 5 = 0 AND idx % 97 = 0 THEN 0 ELSE 255 END AS a
FROM (SELECT image_id, idx, image_id % 3 AS kind, CASE WHEN v > 0 THEN 220 ELSE 20 END AS tone,
        ((floor(v * 1000)::BIGINT % 256) + 256) % 256 AS n1, ((floor(v * 3000)::BIGINT % 256) + 256) % 256 AS n3,
        ((floor(v * 7000)::BIGINT % 256) + 256) % 256 AS n7
      FROM (SELECT vec_id // 36 AS image_id, (vec_id % 36) * 64 + d AS idx, CAST(e AS DOUBLE) AS v
            FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS d FROM embeddings)))""")

cte("v_box", """
SELECT image_id * 4 + k AS region_id, image_id, k * 9.0::DOUBLE - 3.5 AS "left", k * 7.0::DOUBLE + 1.25 AS top,
       12.0::DOUBLE + image_id % 7 AS width, 10.0::DOUBLE + k * 5 AS height, 48 AS image_w, 48 AS image_h
FROM (SELECT DISTINCT vec_id // 36 AS image_id FROM embeddings), (SELECT unnest(range(4)) AS k)""")

cte("v_seen", """
SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY py, px) - 1 AS idx,
       r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS lum,
       (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS bucket
FROM v_pixel WHERE a <> 0""")

cte("v_edge", """
SELECT image_id,
  CAST(sum(CASE WHEN idx % 48 > 0 AND abs(lum - l1) >= 32 THEN 1 ELSE 0 END
         + CASE WHEN idx >= 48 AND abs(lum - l48) >= 32 THEN 1 ELSE 0 END) AS BIGINT) AS edge_count,
  CAST(sum(CASE WHEN idx % 48 > 0 THEN 1 ELSE 0 END + CASE WHEN idx >= 48 THEN 1 ELSE 0 END) AS BIGINT) AS edge_pairs
FROM (SELECT image_id, idx, lum, lag(lum, 1) OVER w AS l1, lag(lum, 48) OVER w AS l48
      FROM v_seen WINDOW w AS (PARTITION BY image_id ORDER BY idx))
GROUP BY image_id""")

# --- edit logs -------------------------------------------------------------------------

cte("v_event", """
SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
       CASE WHEN event_id % 97 = 0 THEN 'reset' WHEN event_type = 'view' THEN 'add' WHEN event_type = 'click' THEN 'update'
            WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'purchase' THEN 'replace'
            WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 2 = 1 THEN 'undo' ELSE 'redo' END AS action
FROM events""")

cte("v_edit", """
SELECT user_id AS doc_id, event_id AS log_pos, 'e' || (k % 10) AS id,
       ['text', 'cover', 'image', 'line'][CAST(k % 4 AS INTEGER) + 1] AS kind, CAST(k % 3 AS INTEGER) AS page_index,
       CAST(k AS DOUBLE) AS x, k * 2.0::DOUBLE AS y, k + 10.0::DOUBLE AS w, 5.0::DOUBLE AS h, event_id % 50 AS z,
       't' || event_id AS text,
       CASE WHEN k % 4 = 0 AND k % 2 = 0 THEN 'free' END AS origin,
       CASE WHEN k % 4 = 0 AND k % 2 = 0 AND k % 3 = 0 THEN 'b' || (event_id % 4) END AS box_id,
       CASE WHEN k % 4 = 0 AND k % 2 = 0 AND k % 5 = 0 THEN 'box t' || event_id END AS box_text,
       CASE WHEN k % 4 = 0 AND k % 2 = 0 AND k % 4 = 0 THEN 30.0::DOUBLE END AS box_height,
       12.0::DOUBLE AS font_size_pt, event_id % 2 = 0 AS sample_background
FROM v_event WHERE action IN ('add', 'replace')""")

# --- provider attempts, requests, chat ------------------------------------------------------

cte("v_attempt", """
SELECT event_id // 3 AS request_id, event_id % 3 AS seq, ['primary', 'backup', 'local'][CAST(event_id % 3 AS INTEGER) + 1] AS provider,
       ['translate', 'explain', 'speak', 'transcribe', 'discuss'][CAST((event_id // 3) % 5 AS INTEGER) + 1] AS method,
       event_type <> 'error' AS ok, value AS ms,
       CASE WHEN event_type = 'error' THEN 'HTTP ' || (event_id % 7 + 500) END AS error
FROM events""")

cte("v_supported", """
SELECT * FROM v_attempt
WHERE provider = 'primary' OR (provider = 'backup' AND method <> 'discuss') OR (provider = 'local' AND method = 'speak')""")

cte("v_request", """
SELECT event_id AS request_no, date_trunc('second', ts) AS ts, CASE WHEN event_id % 11 = 0 THEN 'GET' ELSE 'POST' END AS method,
       ['text-to-speech', 'speech-to-text', 'v1/chat/completions', 'other'][CAST(event_id % 4 AS INTEGER) + 1] AS path,
       CASE event_id % 5 WHEN 0 THEN 'https://other.example' WHEN 1 THEN NULL ELSE 'https://app.example' END AS origin,
       CASE WHEN event_id % 13 = 0 THEN 13000000 WHEN event_id % 17 = 0 THEN NULL ELSE 1000 END AS content_length,
       CASE WHEN user_id % 3 = 2 THEN 'unknown' ELSE '10.0.0.' || user_id END AS client_ip
FROM events""")

cte("v_rate", """
SELECT *, count(*) OVER (PARTITION BY client_ip ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS in_window
FROM v_request""")

cte("v_chat", """
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN '[[NOT_IN_DOCUMENT]] ' || text
         WHEN role = 'assistant' THEN text || ' [Page 2]  [pages 3-4]' ELSE text END AS text
FROM conversations""")

# --- dates ------------------------------------------------------------------------------------

cte("v_dated", """
SELECT o_orderkey AS line_id, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 11 AS d2, o_orderkey % 7 AS k,
       strftime(o_orderdate, '%-d %b %Y') AS named, strftime(o_orderdate, '%d/%m/%Y') AS dmy,
       strftime(CAST(o_orderdate AS DATE) + 11, '%-d %b %Y') AS named2, strftime(CAST(o_orderdate AS DATE) + 11, '%d/%m/%Y') AS dmy2,
       700.0::DOUBLE - (o_orderkey % 40) * 14 AS y
FROM orders""")

# What each template must yield, stated from the template itself.
cte("v_span", """
SELECT line_id, y, raw, "start", start_iso, end_iso, all_day, alt_start_iso, alt_end_iso, context,
       40 + 5.0::DOUBLE * "start" AS x, 5.0::DOUBLE * length(raw) AS w FROM (
  SELECT line_id, y, named AS raw, 12 AS "start", strftime(d, '%Y-%m-%d') AS start_iso, NULL AS end_iso, true AS all_day,
         NULL AS alt_start_iso, NULL AS alt_end_iso, 'Travel date ' || named AS context FROM v_dated WHERE k = 0
  UNION ALL
  SELECT line_id, y, named || ' - ' || named2, 14, strftime(d, '%Y-%m-%d'), strftime(d2, '%Y-%m-%d'), true, NULL, NULL,
         'Travel dates: ' || named || ' - ' || named2 FROM v_dated WHERE k = 1
  UNION ALL
  SELECT line_id, y, dmy, 7, strftime(d, '%Y-%m-%d'), NULL, true,
         CASE WHEN day(d) <= 12 AND day(d) <> month(d) THEN printf('%04d-%02d-%02d', year(d), day(d), month(d)) END, NULL,
         'Return ' || dmy FROM v_dated WHERE k = 2
  UNION ALL
  SELECT line_id, y, dmy || ' to ' || dmy2, 5, strftime(d, '%Y-%m-%d'), strftime(d2, '%Y-%m-%d'), true,
         CASE WHEN day(d) <= 12 THEN printf('%04d-%02d-%02d', year(d), day(d), month(d)) END,
         CASE WHEN day(d) <= 12 AND day(d2) <= 12 THEN printf('%04d-%02d-%02d', year(d2), day(d2), month(d2)) END,
         'Stay ' || dmy || ' to ' || dmy2 FROM v_dated WHERE k = 3
  UNION ALL
  SELECT line_id, y, named, 0, strftime(d, '%Y-%m-%d'), NULL, true, NULL, NULL, named || ' at 3pm and 14:30' FROM v_dated WHERE k = 4
  UNION ALL
  SELECT line_id, y, '3pm', length(named) + 4, strftime(d, '%Y-%m-%d') || 'T15:00:00Z', NULL, false, NULL, NULL,
         named || ' at 3pm and 14:30' FROM v_dated WHERE k = 4
  UNION ALL
  SELECT line_id, y, '14:30', length(named) + 12, strftime(d, '%Y-%m-%d') || 'T14:30:00Z', NULL, false, NULL, NULL,
         named || ' at 3pm and 14:30' FROM v_dated WHERE k = 4
  UNION ALL
  SELECT line_id, y, '18:45', 11, '2024-05-17T18:45:00Z', NULL, false, NULL, NULL, 'Doors open 18:45' FROM v_dated WHERE k = 6)""")

# --- html spans ------------------------------------------------------------------------------------

# Styling in these pages is one <b> that is never closed, so bold is "a <b> came before".
cte("v_token", r"""
SELECT page_id, unnest(ts) AS tok, unnest(range(len(ts))) AS tok_ord
FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|[^<]+') AS ts FROM pages)""")

cte("v_piece", r"""
SELECT page_id, tok_ord, tag, n_bold > 0 AS bold,
       CASE WHEN tag = '' THEN regexp_replace(replace(replace(replace(tok, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;?', '&', 'g')
            WHEN tag = 'br' THEN chr(10) ELSE '' END AS txt
FROM (SELECT *, lower(regexp_extract(tok, '^<([a-zA-Z0-9]+)', 1)) AS tag,
        sum(CASE WHEN tok = '<b>' THEN 1 WHEN tok = '</b>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY tok_ord ROWS UNBOUNDED PRECEDING) AS n_bold
      FROM v_token)
WHERE tag <> '' OR NOT starts_with(tok, '<')""")

cte("v_html_span", r"""
SELECT page_id, tok_ord, bold, CASE WHEN needs_break THEN chr(10) ELSE txt END AS text
FROM (SELECT *, tag IN ('div', 'li', 'p') AND so_far <> '' AND right(so_far, 1) <> chr(10) AS needs_break
      FROM (SELECT p.*, coalesce(last_value(nullif(CASE WHEN tag IN ('', 'br') THEN txt WHEN tag IN ('div', 'li', 'p') AND seen THEN chr(10) END, '') IGNORE NULLS)
              OVER (PARTITION BY page_id ORDER BY tok_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS so_far
            FROM (SELECT *, count(nullif(txt, '')) OVER (PARTITION BY page_id ORDER BY tok_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen FROM v_piece) p))
WHERE needs_break OR txt <> ''""")


def wrap_sql(source: str, tail: str) -> str:
    """Greedy wrap of ``source(doc_id, text)`` as ``v_wrapped(doc_id, l, i, chunk, line_at)``.

    A fold over the tokens of each logical line; 40 characters fit at size 10 in 220 points.
    """
    wrapped = r"""
 SELECT doc_id, l, line_at, unnest(lines) AS chunk, unnest(range(len(lines))) AS i FROM (
  SELECT doc_id, l, line_at, CASE WHEN line = '' THEN [''] ELSE list_append(f.o, f.c) END AS lines FROM (
   SELECT doc_id, l, line, line_at, list_reduce(list_prepend({'o': []::VARCHAR[], 'c': ''}, [{'o': []::VARCHAR[], 'c': t} FOR t IN regexp_extract_all(line, '\s+|\S+')]),
     lambda a, b: CASE WHEN length(a.c || b.c) <= 40 THEN {'o': a.o, 'c': a.c || b.c}
       WHEN length(b.c) <= 40 THEN {'o': CASE WHEN a.c = '' THEN a.o ELSE list_append(a.o, a.c) END, 'c': b.c}
       ELSE {'o': list_concat(CASE WHEN a.c = '' THEN a.o ELSE list_append(a.o, a.c) END,
                [b.c[k * 40 + 1 : k * 40 + 40] FOR k IN range((length(b.c) + 39) // 40 - 1)]),
             'c': b.c[((length(b.c) + 39) // 40 - 1) * 40 + 1 :]} END) AS f
   FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at
         FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS l
               FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM (SOURCE))))))"""
    wrapped = wrapped.replace("SOURCE", source)
    return tail.replace("v_wrapped", f"({wrapped})")


def glyph_wrap_sql(source: str, tail: str, limit: int) -> str:
    """Greedy wrap by advance widths of ``source(doc_id, text, flags, k0, k1)`` as ``v_wrapped(doc_id, l, i, chunk, line_at)``.

    ``flags`` has a 0 or 1 for each character of ``text``, which chooses the face number ``k0`` or ``k1``;
    ``limit`` is in thousandths of the size. Over-long words are single characters, the first of which opens a line.
    """
    names = list(metrics.FACES)
    rows = []
    for k, name in enumerate(names):
        known = metrics.widths(name)
        direct = [known.get(chr(c), metrics.FALLBACK) for c in range(metrics.DIRECT)]
        rows.append(f"({k}, {direct}, {[known[c] for c in metrics.TYPOGRAPHIC]})")
    width = f"""coalesce(CASE WHEN unicode(CH) < {metrics.DIRECT} THEN (CASE WHEN FLAG = '1' THEN t1 ELSE t0 END)[unicode(CH) + 1]
      ELSE (CASE WHEN FLAG = '1' THEN o1 ELSE o0 END)[instr('{metrics.TYPOGRAPHIC}', CH)] END, {metrics.FALLBACK})"""
    of = width.replace("CH", "substr(tok, i, 1)").replace("FLAG", "substr(flags, tok_at + i, 1)")
    wrapped = rf"""
 SELECT * FROM (WITH faces(k, t, o) AS (VALUES {", ".join(rows)}),
 texts AS (SELECT *, string_split(text, chr(10)) AS ls FROM ({source})),
 lines AS (SELECT doc_id, flags, k0, k1, line, l, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_at
           FROM (SELECT *, unnest(ls) AS line, unnest(range(len(ls))) AS l FROM texts)),
 tokens AS (SELECT *, line_at + CAST(coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, l ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tok_at
            FROM (SELECT doc_id, flags, k0, k1, l, line_at, unnest(ts) AS tok, unnest(range(len(ts))) AS n
                  FROM (SELECT *, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, '\s+|\S+') END AS ts FROM lines))),
 sized AS (SELECT doc_id, l, line_at, n, tok, [{of} FOR i IN range(1, length(tok) + 1)] AS ws
           FROM tokens, (SELECT k AS a, t AS t0, o AS o0 FROM faces), (SELECT k AS b, t AS t1, o AS o1 FROM faces) WHERE a = k0 AND b = k1),
 pieces AS (SELECT doc_id, l, line_at, flatten(list(CASE WHEN coalesce(list_sum(ws), 0) <= {limit} THEN [{{'o': []::VARCHAR[], 'c': tok, 'w': CAST(coalesce(list_sum(ws), 0) AS BIGINT), 'm': false}}]
              ELSE [{{'o': []::VARCHAR[], 'c': substr(tok, i, 1), 'w': CAST(ws[i] AS BIGINT), 'm': i = 1}} FOR i IN range(1, length(tok) + 1)] END ORDER BY n)) AS ps
            FROM sized GROUP BY doc_id, l, line_at)
 SELECT doc_id, l, line_at, unnest(lines) AS chunk, unnest(range(len(lines))) AS i FROM (
  SELECT doc_id, l, line_at, list_append(f.o, f.c) AS lines FROM (
   SELECT doc_id, l, line_at, list_reduce(ps, lambda a, b: CASE WHEN b.m OR a.w + b.w > {limit} THEN {{'o': list_append(a.o, a.c), 'c': b.c, 'w': b.w, 'm': false}}
     ELSE {{'o': a.o, 'c': a.c || b.c, 'w': a.w + b.w, 'm': false}} END) AS f FROM pieces)))"""
    return tail.replace("v_wrapped", f"({wrapped})")
