"""The same queries as DuckDB SQL, written apart from the DataFrame code."""

from __future__ import annotations

from provena.plans.queries import AS_OF
from provena.sources.adapters import duckdb_views

# Fixed values that decide results: editing tools, keywords and months, as in provena.functions.scalars.
_TOOLS = "photoshop|gimp|canva|illustrator|paint|pixlr|snapseed|picsart|lightroom|foxit phantom|pdfescape|sejda|smallpdf|ilovepdf|pdf-xchange|nitro|acrobat pro|inkscape|affinity"
_KW = "(?i)grand|total|sub-?total|gst|cgst|sgst|igst|vat|tax|discount|net|balance"
_MON = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"

#: name: (what it reads, SQL of a common table expression)
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "tok": (
        ("words",),
        rf"""SELECT *, regexp_full_match(c, '{_KW}') AS kw, num AND (c LIKE '%,%' OR c LIKE '%.%') AND length(c) >= 4 AS money,
          CASE WHEN regexp_full_match(replace(c, ',', ''), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN try_cast(replace(c, ',', '') AS DOUBLE) END AS val,
          word_no // 100 AS line_no, word_no % 100 AS pos
        FROM (SELECT *, regexp_full_match(c, '[$₹€£]?[0-9][0-9,.]*%?') AS num FROM (SELECT *, trim(text, '.,;:()[]|') AS c FROM words))""",
    ),
    "ln": (
        ("tok",),
        """SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY pos) AS line_text, list({'pos': pos, 'text': text, 'c': c, 'num': num, 'money': money, 'val': val, 'kw': kw, 'x': x, 'y': y, 'w': w, 'h': h} ORDER BY pos) AS toks,
          concat_ws(',', min(x), min(y), max(x + w) - min(x), max(y + h) - min(y)) AS box FROM tok GROUP BY ALL""",
    ),
    "dates": (
        ("ln",),
        rf"""SELECT *, CASE WHEN kind = 'ymd' THEN try_cast(g[1] || '-' || lpad(g[2], 2, '0') || '-' || lpad(g[3], 2, '0') AS DATE)
          ELSE try_cast(lpad((g[3]::INT + CASE WHEN g[3]::INT < 100 THEN 2000 ELSE 0 END)::VARCHAR, 4, '0') || '-' || lpad(CASE WHEN kind = 'dmy' THEN g[2] ELSE (list_position(string_split('{_MON}', '|'), lower(g[2][1:3])))::VARCHAR END, 2, '0') || '-' || lpad(g[1], 2, '0') AS DATE) END AS date
        FROM (SELECT *, CASE kind WHEN 'dmy' THEN regexp_split_to_array(found, '[/.-]') WHEN 'ymd' THEN regexp_split_to_array(found, '[/.-]') ELSE regexp_split_to_array(replace(replace(found, ',', ''), '.', ''), '\s+') END AS g FROM (
          SELECT doc_id, page, line_no, box, 'dmy' AS kind, unnest(regexp_extract_all(line_text, '\b\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}\b')) AS found FROM ln
          UNION ALL SELECT doc_id, page, line_no, box, 'ymd', unnest(regexp_extract_all(line_text, '\b\d{{4}}[/.-]\d{{1,2}}[/.-]\d{{1,2}}\b')) FROM ln
          UNION ALL SELECT doc_id, page, line_no, box, 'dMy', unnest(regexp_extract_all(line_text, '(?i)\b\d{{1,2}}\s+(?:{_MON})[a-z]*\.?,?\s+\d{{2,4}}\b')) FROM ln))""",
    ),
    "date_flags": (
        ("dates",),
        f"""SELECT doc_id, page, found AS field, CASE WHEN date IS NULL THEN 'Impossible calendar date' WHEN date > DATE '{AS_OF}' THEN 'Date is in the future (' || strftime(date, '%d %b %Y') || ')' ELSE 'Implausibly old date' END AS reason,
          CASE WHEN date IS NULL THEN 'high' WHEN date > DATE '{AS_OF}' THEN 'medium' ELSE 'low' END AS severity, 'rule' AS check_name, box, 'red' AS marker
        FROM dates WHERE date IS NULL OR date > DATE '{AS_OF}' OR year(date) < 1990""",
    ),
    "swapped_flags": (
        ("dates",),
        f"""SELECT doc_id, page, found AS field, CASE WHEN date IS NULL THEN 'Impossible calendar date' WHEN date > DATE '{AS_OF}' THEN 'Date is in the future (' || strftime(date, '%d %b %Y') || ')' ELSE 'Implausibly old date' END AS reason,
          CASE WHEN date IS NULL THEN 'high' WHEN date > DATE '{AS_OF}' THEN 'medium' ELSE 'low' END AS severity, 'rule' AS check_name, box, 'red' AS marker
        FROM (SELECT doc_id, page, found, box, coalesce(date, CASE WHEN kind = 'dmy' THEN try_cast(lpad((g[3]::INT + CASE WHEN g[3]::INT < 100 THEN 2000 ELSE 0 END)::VARCHAR, 4, '0') || '-' || lpad(g[1], 2, '0') || '-' || lpad(g[2], 2, '0') AS DATE) END) AS date FROM dates)
        WHERE date IS NULL OR date > DATE '{AS_OF}' OR year(date) < 1990""",
    ),
    "mixed_flags": (
        ("dates",),
        """SELECT doc_id, page, 'Dates' AS field, 'Mixed date formats in one document: [''' || string_agg(DISTINCT kind, ''', ''' ORDER BY kind) || ''']' AS reason, 'low' AS severity, 'rule' AS check_name, NULL::VARCHAR AS box, 'red' AS marker
        FROM dates GROUP BY doc_id, page HAVING count(DISTINCT kind) > 1""",
    ),
    "plain_mixed_flags": (("mixed_flags",), "SELECT * REPLACE ('Mixed date formats in one document' AS reason) FROM mixed_flags"),
    "pdf_dates": (
        ("pdf_meta",),
        r"""SELECT *, try_strptime(c[1:4] || '-' || coalesce(nullif(c[5:6], ''), '01') || '-' || coalesce(nullif(c[7:8], ''), '01') || ' ' || coalesce(nullif(c[9:10], ''), '00') || ':' || coalesce(nullif(c[11:12], ''), '00') || ':' || coalesce(nullif(c[13:14], ''), '00'), '%Y-%m-%d %H:%M:%S') AS created,
          try_strptime(m[1:4] || '-' || coalesce(nullif(m[5:6], ''), '01') || '-' || coalesce(nullif(m[7:8], ''), '01') || ' ' || coalesce(nullif(m[9:10], ''), '00') || ':' || coalesce(nullif(m[11:12], ''), '00') || ':' || coalesce(nullif(m[13:14], ''), '00'), '%Y-%m-%d %H:%M:%S') AS modified
        FROM (SELECT *, regexp_extract(creation_date, '^D:(\d{4,14})', 1) AS c, regexp_extract(mod_date, '^D:(\d{4,14})', 1) AS m FROM pdf_meta)""",
    ),
    "pdf_flags": (
        ("pdf_dates",),
        f"""SELECT doc_id, 1 AS page, field, reason, severity, 'metadata' AS check_name, NULL::VARCHAR AS box, 'red' AS marker FROM (
          SELECT doc_id, 'PDF metadata' AS field, 'Producer/Creator mentions an editing tool: ''' || trim(coalesce(producer, '') || ' ' || coalesce(creator, '')) || '''' AS reason, 'medium' AS severity FROM pdf_dates WHERE regexp_matches(lower(coalesce(producer, '') || ' ' || coalesce(creator, '')), '{_TOOLS}')
          UNION ALL SELECT doc_id, 'PDF metadata', 'Modified (' || strftime(modified, '%Y-%m-%d %H:%M:%S') || ') well after creation (' || strftime(created, '%Y-%m-%d %H:%M:%S') || ')', 'medium' FROM pdf_dates WHERE epoch(modified) - epoch(created) > 60
          UNION ALL SELECT doc_id, 'PDF metadata', 'Metadata stripped (no creation date or producer)', 'low' FROM pdf_dates WHERE coalesce(creation_date, '') = '' AND coalesce(producer, '') = ''
          UNION ALL SELECT doc_id, 'PDF structure', eof_count || ' %%EOF markers: file was saved incrementally', 'medium' FROM pdf_dates WHERE eof_count > 1
          UNION ALL SELECT doc_id, 'PDF structure', 'Contains redaction/free-text/shape annotations that can cover content', 'medium' FROM pdf_dates WHERE has_annot AND has_cover_annot)""",
    ),
    "exif_flags": (
        ("exif_fields",),
        f"""SELECT doc_id, 1 AS page, field, reason, severity, 'metadata' AS check_name, NULL::VARCHAR AS box, 'red' AS marker FROM (
          SELECT doc_id, 'EXIF' AS field, 'JPEG has no EXIF data (stripped or re-exported)' AS reason, 'low' AS severity FROM exif_fields WHERE NOT has_tags AND format = 'JPEG'
          UNION ALL SELECT doc_id, 'EXIF Software', CASE WHEN regexp_matches(lower(software), '{_TOOLS}') THEN 'Image saved by editing software: ''' ELSE 'Software tag present: ''' END || software || '''', CASE WHEN regexp_matches(lower(software), '{_TOOLS}') THEN 'high' ELSE 'low' END FROM exif_fields WHERE has_tags AND software <> ''
          UNION ALL SELECT doc_id, 'EXIF dates', 'DateTime (' || taken_changed || ') differs from DateTimeOriginal (' || original || ')', 'medium' FROM exif_fields WHERE has_tags AND taken_changed <> '' AND original <> '' AND taken_changed <> original)""",
    ),
    "sp": (
        ("spans",),
        r"""SELECT *, trim(text) AS t, regexp_full_match(trim(trim(text), '.,;:()[]|'), '[$₹€£]?[0-9][0-9,.]*%?') AS num, len(regexp_extract_all(text, '[\p{L}\p{N}]')) AS alnum,
          lower(regexp_replace(regexp_replace(font, '^[A-Z]{6}\+', ''), '([-_, ]?(bold|italic|oblique|black|semibold|demi|medium|light|regular|roman|mt|ps))+$', '', 'i')) AS family,
          concat_ws(',', trunc(x0 * scale)::INT, trunc(y0 * scale)::INT, trunc(x1 * scale)::INT - trunc(x0 * scale)::INT, trunc(y1 * scale)::INT - trunc(y0 * scale)::INT) AS box
        FROM spans WHERE trim(text) <> ''""",
    ),
    "split_flags": (
        ("sp",),
        r"""SELECT doc_id, page, text[-3:] || b.text[1:3] AS field, 'One word is rendered in two fonts (' || font || ' ' || format('{:.1f}', size) || 'pt / ' || b.font || ' ' || format('{:.1f}', b.size) || 'pt)' AS reason, 'high' AS severity, 'font' AS check_name,
          concat_ws(',', trunc(least(x0, b.x0) * scale)::INT, trunc(least(y0, b.y0) * scale)::INT, trunc(greatest(x1, b.x1) * scale)::INT - trunc(least(x0, b.x0) * scale)::INT, trunc(greatest(y1, b.y1) * scale)::INT - trunc(least(y0, b.y0) * scale)::INT) AS box, 'yellow' AS marker
        FROM (SELECT *, lead({'text': text, 'family': family, 'font': font, 'size': size, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) OVER (PARTITION BY doc_id, page, block_no, line_no ORDER BY span_no) AS b FROM sp)
        WHERE b IS NOT NULL AND regexp_matches(text[-1:], '[\p{L}\p{N}]') AND regexp_matches(b.text[1:1], '[\p{L}\p{N}]') AND (regexp_matches(text[-1:], '\d') OR regexp_matches(b.text[1:1], '\d')) AND (family <> b.family OR abs(size - b.size) > 0.5)""",
    ),
    "rare_number_flags": (
        ("sp",),
        """SELECT doc_id, page, t AS field, 'Number uses font family ''' || font || '''; ' || format('{:.0f}', 100 * (1 - k / n)) || '% of other numbers use a different font family' AS reason, 'medium' AS severity, 'font' AS check_name, box, 'yellow' AS marker
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n, count(*) OVER (PARTITION BY doc_id, page, family) AS k FROM sp WHERE num) WHERE n >= 5 AND k / n <= 0.15""",
    ),
    "rare_text_flags": (
        ("sp",),
        r"""SELECT doc_id, page, t AS field, 'Text set in font ''' || font || ''' while ' || format('{:.0f}', 100 * top / chars) || '% of page uses ''' || dominant || ''' family' AS reason, 'medium' AS severity, 'font' AS check_name, box, 'yellow' AS marker
        FROM sp JOIN (SELECT doc_id AS d, page AS p, family AS f, sum(alnum) AS own FROM sp GROUP BY ALL) w ON w.d = doc_id AND w.p = page AND w.f = family
        JOIN (SELECT d2, p2, sum(own) AS chars, arg_max(f2, (own, -first)) AS dominant, max(own) AS top FROM (SELECT doc_id AS d2, page AS p2, family AS f2, sum(alnum) AS own, min(line_no * 100 + span_no) AS first FROM sp GROUP BY ALL) GROUP BY ALL) g ON g.d2 = doc_id AND g.p2 = page
        WHERE chars >= 40 AND top / chars >= 0.5 AND family <> dominant AND own / chars <= 0.15 AND len(regexp_extract_all(t, '[\p{L}\p{N}]')) >= 2 AND NOT num""",
    ),
    "font_count_flags": (("page_fonts",), "SELECT doc_id, page, 'Fonts' AS field, count(*) || ' distinct fonts embedded on one page' AS reason, 'low' AS severity, 'font' AS check_name, NULL::VARCHAR AS box, 'yellow' AS marker FROM page_fonts GROUP BY doc_id, page HAVING count(*) > 6"),
    "layer_nums": (
        ("layer_words",),
        "SELECT * FROM (SELECT *, trim(text, '.,') AS t, row_number() OVER (PARTITION BY doc_id, page, trim(text, '.,') ORDER BY word_no DESC) AS r FROM layer_words) WHERE r = 1 AND length(t) >= 3 AND regexp_full_match(trim(t, '.,;:()[]|'), '[$₹€£]?[0-9][0-9,.]*%?')",
    ),
    "page_nums": (("tok",), "SELECT * FROM (SELECT *, trim(text, '.,') AS t, row_number() OVER (PARTITION BY doc_id, page, trim(text, '.,') ORDER BY word_no DESC) AS r FROM tok WHERE num AND length(text) >= 3 AND conf >= 70) WHERE r = 1"),
    "hidden_flags": (
        ("layer_nums", "page_nums"),
        """SELECT doc_id, page, t AS field, 'Present in PDF text layer but not visible on rendered page' AS reason, 'high' AS severity, 'layer' AS check_name,
          concat_ws(',', trunc(x0 * scale)::INT, trunc(y0 * scale)::INT, trunc((x1 - x0) * scale)::INT, trunc((y1 - y0) * scale)::INT) AS box, 'red' AS marker FROM layer_nums l
        WHERE EXISTS (FROM page_nums p WHERE p.doc_id = l.doc_id AND p.page = l.page) AND NOT EXISTS (FROM page_nums p WHERE p.doc_id = l.doc_id AND p.page = l.page AND p.t = l.t)""",
    ),
    "overlay_flags": (
        ("layer_nums", "page_nums", "layer_words"),
        """SELECT doc_id, page, t AS field, 'Visible on page but absent from PDF text layer' AS reason, 'medium' AS severity, 'layer' AS check_name, concat_ws(',', x, y, w, h) AS box, 'red' AS marker FROM page_nums p
        WHERE EXISTS (FROM layer_words l WHERE p.doc_id = l.doc_id AND p.page = l.page) AND NOT EXISTS (FROM layer_nums l WHERE p.doc_id = l.doc_id AND p.page = l.page AND p.t = l.t)""",
    ),
    "height_z": (
        ("tok",),
        """SELECT *, 0.6745 * (h - med) / coalesce(nullif(median(abs(h - med)) OVER (PARTITION BY doc_id, page), 0), 1e-6) AS z FROM (
          SELECT *, median(h) OVER (PARTITION BY doc_id, page) AS med, count(*) OVER (PARTITION BY doc_id, page) AS n FROM tok WHERE money AND conf >= 0)""",
    ),
    "height_flags": (
        ("height_z",),
        "SELECT doc_id, page, text AS field, 'Digit height ' || h || 'px vs typical ' || format('{:.0f}', med) || 'px for numbers on the page' AS reason, 'low' AS severity, 'layout' AS check_name, concat_ws(',', x, y, w, h) AS box, 'red' AS marker FROM height_z WHERE n >= 8 AND abs(z) > 4 AND abs(h - med) / med > 0.35",
    ),
    "low_conf_flags": (
        ("tok",),
        "SELECT doc_id, page, text AS field, 'Low OCR confidence (' || format('{:.0f}', conf) || '%) on numeric field' AS reason, 'low' AS severity, 'layout' AS check_name, concat_ws(',', x, y, w, h) AS box, 'red' AS marker, word_no FROM tok WHERE money AND conf >= 0 AND conf < 40",
    ),
    "ela_z": (
        ("ela_scores",),
        """SELECT *, 0.6745 * (ela - med) / coalesce(nullif(median(abs(ela - med)) OVER (PARTITION BY doc_id, page), 0), 1e-6) AS z FROM (
          SELECT *, median(ela) OVER (PARTITION BY doc_id, page) AS med, count(*) OVER (PARTITION BY doc_id, page) AS n FROM ela_scores WHERE w >= 4 AND h >= 4)""",
    ),
    "ela_flags": (
        ("ela_z",),
        "SELECT doc_id, 1 AS page, text AS field, 'Error-level anomaly: compression error ' || format('{:.1f}', ela) || ' vs median ' || format('{:.1f}', med) AS reason, 'high' AS severity, 'ela' AS check_name, concat_ws(',', x, y, w, h) AS box, 'red' AS marker FROM ela_z WHERE n >= 8 AND z > 5 AND ela > 2.5 * med",
    ),
    "number_flags": (
        ("tok",),
        r"""SELECT doc_id, page, c AS field, unnest(reasons) AS reason, 'medium' AS severity, 'rule' AS check_name, concat_ws(',', x, y, w, h) AS box, 'red' AS marker FROM (
          SELECT *, list_filter([CASE WHEN alike THEN 'Letters mixed into a number (O/0, l/1, S/5)' END, CASE WHEN bad THEN 'Malformed thousands separators' END], lambda r: r IS NOT NULL) AS reasons FROM (
            SELECT *, regexp_full_match(c, '[\dOolISBZ,.]{3,}') AND len(regexp_extract_all(c, '\d')) > 0 AND len(regexp_extract_all(c, '[OolISBZ]')) > 0 AND len(regexp_extract_all(c, '\d')) / length(c) >= 0.5 AS alike,
              c LIKE '%,%' AND num AND length(c) >= 5 AND NOT regexp_full_match(regexp_replace(regexp_replace(c, '^[$₹€£]+', ''), '%+$', ''), '\d{1,3}(,\d{3})+(\.\d+)?') AND NOT regexp_full_match(regexp_replace(regexp_replace(c, '^[$₹€£]+', ''), '%+$', ''), '\d{1,2}(,\d{2})+,\d{3}(\.\d+)?') AS bad FROM tok))""",
    ),
    "places": (("tok",), "SELECT *, length(string_split(regexp_replace(c, '%+$', ''), '.')[-1]) AS dp FROM tok WHERE num AND c LIKE '%.%'"),
    "decimal_flags": (
        ("places",),
        """SELECT p.doc_id, p.page, text AS field, dp || ' decimal places while most amounts use ' || common AS reason, 'low' AS severity, 'rule' AS check_name, concat_ws(',', x, y, w, h) AS box, 'red' AS marker
        FROM places p JOIN (SELECT doc_id, page, sum(k) AS n, arg_max(dp, (k, -first)) AS common FROM (SELECT doc_id, page, dp, count(*) AS k, min(word_no) AS first FROM places GROUP BY ALL) GROUP BY ALL) m ON m.doc_id = p.doc_id AND m.page = p.page
        WHERE n >= 4 AND dp <> common AND dp <= 3""",
    ),
    "merged": (
        ("ln",),
        """SELECT doc_id, page, line_no, CASE WHEN joins THEN list_concat(toks, nxt) ELSE toks END AS toks, CASE WHEN joins THEN line_text || ' ' || next_text ELSE line_text END AS line_text FROM (
          SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id, page ORDER BY line_no), false) AS gone FROM (
            SELECT *, len(toks) <= 2 AND toks[1].kw AND len(list_filter(toks, lambda t: t.num)) = 0 AND coalesce(lower(nxt[1].c) IN ('amount', 'due', 'payable', 'price'), false) AS joins FROM (
              SELECT *, lead(toks) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS nxt, lead(line_text) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS next_text FROM ln))) WHERE NOT gone""",
    ),
    "cls": (
        ("merged",),
        rf"""SELECT *, CASE WHEN k > 0 THEN list_filter(toks[k + 1:], lambda t: t.num AND t.text NOT LIKE '%\%%' ESCAPE '\' AND t.val IS NOT NULL)[-1] END AS stated,
          CASE WHEN k = 0 AND NOT regexp_matches(list_aggregate(list_transform(toks, lambda t: t.c), 'string_agg', ' '), '(?i)phone|tel\b|mob|gstin|cin\b|@|pin\b|invoice\s*(no|date)|due\s*date|\bdate\b') AND lower(toks[1].c) NOT IN ('amount', 'due', 'payable')
            THEN list_filter(toks, lambda t: t.num AND t.c NOT LIKE '%\%%' ESCAPE '\' AND t.val IS NOT NULL) END AS nums,
          CASE WHEN k > 0 THEN lower(list_aggregate(list_transform(toks[k:], lambda t: t.c), 'string_agg', ' ')) END AS seg,
          max(regexp_matches(line_text, '(?i)\b(qty|quantity)\b')) OVER (PARTITION BY doc_id, page) AS wanted
        FROM (SELECT *, CASE WHEN kk > 0 AND (mm = 0 OR kk < mm) THEN kk ELSE 0 END AS k FROM (
          SELECT *, coalesce(list_position(list_transform(toks, lambda t: t.kw), true), 0) AS kk, coalesce(list_position(list_transform(toks, lambda t: t.money), true), 0) AS mm FROM merged))""",
    ),
    "lined": (
        ("cls",),
        r"""SELECT *, list_filter(nums, lambda t: t.money)[-1] AS amount, CASE WHEN stated IS NULL THEN NULL WHEN regexp_matches(seg, '^sub-?\s*total') THEN 'subtotal' WHEN regexp_matches(seg, '^(grand|total|net|balance)') THEN 'total' WHEN regexp_matches(seg, '^(gst|cgst|sgst|igst|vat|tax)') THEN 'tax' WHEN regexp_matches(seg, '^discount') THEN 'discount' END AS kind FROM cls""",
    ),
    "row_flags": (
        ("lined",),
        """SELECT doc_id, page, amount.text AS field, 'Row arithmetic: qty ' || format('{:g}', q) || ' x unit price ' || format('{:,.2f}', u) || ' = ' || format('{:,.2f}', q * u) || ', but amount shown is ' || format('{:,.2f}', a) AS reason, 'high' AS severity, 'rule' AS check_name, concat_ws(',', amount.x, amount.y, amount.w, amount.h) AS box, 'red' AS marker
        FROM (SELECT *, nums[-3].val AS q, nums[-2].val AS u, amount.val AS a FROM lined WHERE amount IS NOT NULL AND wanted AND len(nums) >= 3 AND nums[-2].money) WHERE abs(q * u - a) > 0.02 AND abs(u - a) > 0.02""",
    ),
    "sums": (
        ("lined",),
        r"""SELECT *, coalesce(sub.val, plain) AS base FROM (SELECT doc_id, page, count(amount) AS items, sum(amount.val) AS plain,
          sum(amount.val * coalesce(list_filter(list_transform(toks[1:list_position(list_transform(toks, lambda t: t.money), true) - 1], lambda t: t.c), lambda c: regexp_full_match(c, '\d{1,3}'))[-1]::INT, 1)) FILTER (amount IS NOT NULL) AS byq,
          arg_max(stated, line_no) FILTER (kind = 'subtotal') AS sub, arg_max(stated, line_no) FILTER (kind = 'total') AS tot, arg_max(stated, line_no) FILTER (kind = 'tax') AS taxw,
          coalesce(sum(stated.val) FILTER (kind = 'tax'), 0) AS tax, coalesce(sum(stated.val) FILTER (kind = 'discount'), 0) AS disc,
          arg_min(try_cast(regexp_extract(seg, '(\d+(?:\.\d+)?)\s*%', 1) AS DOUBLE), line_no) FILTER (kind = 'tax' AND regexp_matches(seg, '\d\s*%')) AS rate FROM lined GROUP BY doc_id, page) WHERE items > 0""",
    ),
    "total_flags": (
        ("sums",),
        """SELECT doc_id, page, 'Subtotal ' || format('{:,.2f}', sub.val) AS field, 'Line amounts add up to ' || format('{:,.2f}', plain) || ', not the stated subtotal' AS reason, 'high' AS severity, 'rule' AS check_name, concat_ws(',', sub.x, sub.y, sub.w, sub.h) AS box, 'red' AS marker FROM sums WHERE abs(sub.val - plain) > 1
        UNION ALL SELECT doc_id, page, 'Tax ' || format('{:,.2f}', tax), format('{:g}', rate) || '% of ' || format('{:,.2f}', base) || ' is ' || format('{:,.2f}', base * rate / 100) || ', not ' || format('{:,.2f}', tax), 'medium', 'rule', concat_ws(',', taxw.x, taxw.y, taxw.w, taxw.h), 'red' FROM sums WHERE rate <> 0 AND tax <> 0 AND abs(tax - base * rate / 100) > 1
        UNION ALL SELECT doc_id, page, 'Total ' || format('{:,.2f}', tot.val), 'Expected total is ' || format('{:,.2f}', base + tax - disc) || ', but the total shown is ' || format('{:,.2f}', tot.val), CASE WHEN sub IS NOT NULL THEN 'high' ELSE 'medium' END, 'rule', concat_ws(',', tot.x, tot.y, tot.w, tot.h), 'red' FROM sums WHERE abs(base + tax - disc - tot.val) > 1""",
    ),
    "lenient_flags": (
        ("sums",),
        """SELECT doc_id, page, 'Subtotal ' || format('{:,.2f}', sub.val) AS field, 'Line amounts add up to ' || format('{:,.2f}', plain) || ', not the stated subtotal' AS reason, 'high' AS severity, 'rule' AS check_name, concat_ws(',', sub.x, sub.y, sub.w, sub.h) AS box, 'red' AS marker FROM sums WHERE abs(sub.val - plain) > 1 AND abs(sub.val - byq) > 1
        UNION ALL SELECT doc_id, page, 'Tax ' || format('{:,.2f}', tax), format('{:g}', rate) || '% of ' || format('{:,.2f}', base) || ' is ' || format('{:,.2f}', base * rate / 100) || ', not ' || format('{:,.2f}', tax), 'medium', 'rule', concat_ws(',', taxw.x, taxw.y, taxw.w, taxw.h), 'red' FROM sums WHERE rate <> 0 AND tax <> 0 AND abs(tax - base * rate / 100) > 1 AND abs(tax - (base - disc) * rate / 100) > 1
        UNION ALL SELECT doc_id, page, 'Total ' || format('{:,.2f}', tot.val), 'Expected total is ' || format('{:,.2f}', base + tax - disc) || ', but the total shown is ' || format('{:,.2f}', tot.val), CASE WHEN sub IS NOT NULL THEN 'high' ELSE 'medium' END, 'rule', concat_ws(',', tot.x, tot.y, tot.w, tot.h), 'red' FROM sums WHERE abs(base + tax - disc - tot.val) > 1 AND abs(plain + tax - disc - tot.val) > 1 AND abs(byq + tax - disc - tot.val) > 1""",
    ),
    "token_dates": (
        ("tok",),
        r"""SELECT *, CASE WHEN regexp_full_match(c, '\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}') THEN try_cast(lpad((s[3]::INT + CASE WHEN s[3]::INT < 100 THEN 2000 ELSE 0 END)::VARCHAR, 4, '0') || '-' || lpad(s[2], 2, '0') || '-' || lpad(s[1], 2, '0') AS DATE)
          WHEN regexp_full_match(c, '\d{4}[/.-]\d{1,2}[/.-]\d{1,2}') THEN try_cast(s[1] || '-' || lpad(s[2], 2, '0') || '-' || lpad(s[3], 2, '0') AS DATE) END AS date FROM (SELECT *, regexp_split_to_array(c, '[/.-]') AS s FROM tok)""",
    ),
    "labelled": (
        ("token_dates",),
        """SELECT label, doc_id, page, arg_min({'date': date, 'text': text, 'x': x, 'y': y, 'w': w, 'h': h}, word_no) AS v FROM (
          SELECT a.label, d.* FROM (SELECT doc_id, page, line_no, label, min(pos) AS pos FROM (SELECT *, lower(c) || ' ' || lower(lead(c) OVER (PARTITION BY doc_id, page, line_no ORDER BY pos)) AS label FROM token_dates) WHERE label IN ('invoice date', 'issue date', 'due date') GROUP BY ALL) a
          JOIN token_dates d ON d.doc_id = a.doc_id AND d.page = a.page AND d.line_no = a.line_no AND d.pos >= a.pos + 2 WHERE d.date IS NOT NULL) GROUP BY ALL""",
    ),
    "due_flags": (
        ("labelled", "ln"),
        r"""SELECT doc_id, page, due.text AS field, CASE WHEN days < 0 THEN 'Due date (' || strftime(due.date, '%d %b %Y') || ') is earlier than invoice date (' || strftime(inv, '%d %b %Y') || ')' ELSE 'Due date is ' || days || ' days after invoice date but terms say ' || terms || ' days' END AS reason,
          CASE WHEN days < 0 THEN 'high' ELSE 'medium' END AS severity, 'rule' AS check_name, concat_ws(',', due.x, due.y, due.w, due.h) AS box, 'red' AS marker FROM (
          SELECT d.doc_id, d.page, d.v AS due, coalesce(i.v.date, s.v.date) AS inv, datediff('day', coalesce(i.v.date, s.v.date), d.v.date) AS days, nullif(regexp_extract(t.txt, '(?i)within\s+(\d+)\s+days', 1), '') AS terms
          FROM labelled d LEFT JOIN labelled i ON i.label = 'invoice date' AND i.doc_id = d.doc_id AND i.page = d.page LEFT JOIN labelled s ON s.label = 'issue date' AND s.doc_id = d.doc_id AND s.page = d.page
          JOIN (SELECT doc_id, page, string_agg(line_text, ' ' ORDER BY line_no) AS txt FROM ln GROUP BY ALL) t ON t.doc_id = d.doc_id AND t.page = d.page WHERE d.label = 'due date')
        WHERE inv IS NOT NULL AND (days < 0 OR abs(days - try_cast(terms AS DOUBLE)) > 2)""",
    ),
    "in_order": (("crowded_words",), "SELECT *, y + h / 2 AS cy, row_number() OVER (PARTITION BY doc_id, page ORDER BY y + h / 2, word_no) AS i FROM crowded_words"),
    # The rule word by word: step i of every page at once; a step's row has the page's groups after it.
    "placed": (
        ("in_order",),
        """SELECT doc_id, page, 0::BIGINT AS i, 0::BIGINT AS grp, []::STRUCT(total DOUBLE, n INT, tall INT)[] AS groups FROM in_order WHERE i = 1
          UNION ALL SELECT doc_id, page, i, coalesce(fit, len(groups) + 1), CASE WHEN fit IS NULL THEN list_append(groups, {'total': cy, 'n': 1, 'tall': h}) ELSE
            list_concat(groups[:fit - 1], [{'total': groups[fit].total + cy, 'n': groups[fit].n + 1, 'tall': greatest(groups[fit].tall, h)}], groups[fit + 1:]) END
          FROM (SELECT w.*, groups, nullif(list_position(list_transform(groups, lambda g: abs(w.cy - g.total / g.n) < 0.6 * greatest(w.h, g.tall)), true), 0) AS fit
            FROM placed p JOIN in_order w ON w.doc_id = p.doc_id AND w.page = p.page AND w.i = p.i + 1)""",
    ),
    "set_spans": (("sp",), "SELECT *, (y0 + y1) / 2 AS cy, y1 - y0 AS tall, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no, line_no, span_no) AS nth FROM sp"),
    "down": (("set_spans",), "SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY cy, nth) AS i FROM set_spans"),
    "across": (("set_spans",), "SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0, nth) AS i FROM set_spans"),
    # Each step places the next span of every page by the groups' first spans.
    "in_rows": (
        ("down",),
        """SELECT doc_id, page, 0::BIGINT AS i, 0::BIGINT AS grp, []::STRUCT(cy DOUBLE, tall DOUBLE)[] AS heads FROM down WHERE i = 1
          UNION ALL SELECT doc_id, page, i, coalesce(fit, len(heads) + 1), CASE WHEN fit IS NULL THEN list_append(heads, {'cy': cy, 'tall': tall}) ELSE heads END
          FROM (SELECT s.*, heads, nullif(list_position(list_transform(heads, lambda a: abs(s.cy - a.cy) < 0.45 * greatest(s.tall, a.tall)), true), 0) AS fit
            FROM in_rows r JOIN down s ON s.doc_id = r.doc_id AND s.page = r.page AND s.i = r.i + 1)""",
    ),
    "in_columns": (
        ("across",),
        """SELECT doc_id, page, 0::BIGINT AS i, 0::BIGINT AS grp, []::DOUBLE[] AS heads FROM across WHERE i = 1
          UNION ALL SELECT doc_id, page, i, coalesce(fit, len(heads) + 1), CASE WHEN fit IS NULL THEN list_append(heads, x0) ELSE heads END
          FROM (SELECT s.*, heads, nullif(list_position(list_transform(heads, lambda a: abs(s.x0 - a) <= 3), true), 0) AS fit
            FROM in_columns r JOIN across s ON s.doc_id = r.doc_id AND s.page = r.page AND s.i = r.i + 1)""",
    ),
    "grouped": (
        ("in_rows", "in_columns"),
        """SELECT s.*, 'row' AS kind, 2 AS least, 0.7 AS share, grp FROM down s JOIN in_rows r ON r.doc_id = s.doc_id AND r.page = s.page AND r.i = s.i
          UNION ALL SELECT s.*, 'column', 3, 0.6, grp FROM across s JOIN in_columns r ON r.doc_id = s.doc_id AND r.page = s.page AND r.i = s.i""",
    ),
    "peer_votes": (
        ("grouped",),
        r"""SELECT s.doc_id, s.page, s.kind, s.grp, s.nth, s.least, s.share, s.family AS own, o.family, count(*) AS k FROM grouped s JOIN grouped o ON o.doc_id = s.doc_id AND o.page = s.page AND o.kind = s.kind AND o.grp = s.grp AND o.nth <> s.nth
          WHERE o.alnum > 0 AND NOT s.num AND len(regexp_extract_all(s.t, '[\p{L}\p{N}]')) >= 2 GROUP BY ALL""",
    ),
    "context_hits": (
        ("peer_votes", "grouped"),
        """SELECT doc_id, page, nth, CASE kind WHEN 'row' THEN 0 ELSE 2 END AS rule, 'the other text in the same ' || kind || ' uses the ''' || top || ''' family' AS why FROM (
            SELECT doc_id, page, kind, nth, own, least, share, sum(k) AS others, max(k) AS most, arg_max(family, k) AS top FROM peer_votes GROUP BY ALL) WHERE others >= least AND most / others >= share AND top <> own
          UNION ALL SELECT doc_id, page, nth, 1, 'this line mixes ' || families || ' different font families' FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id, page, grp ORDER BY x0, i) AS k, len(list_distinct(list(family) OVER (PARTITION BY doc_id, page, grp))) AS families FROM grouped WHERE kind = 'row' AND alnum >= 2 AND NOT num) WHERE families >= 3 AND k > 1""",
    ),
    "context_flags": (
        ("context_hits", "set_spans", "rare_text_flags"),
        """SELECT doc_id, page, t AS field, 'Text set in ''' || font || ''' but ' || why || ' (edited or inserted text)' AS reason, 'medium' AS severity, 'font' AS check_name, box, 'yellow' AS marker
          FROM set_spans s JOIN (SELECT doc_id, page, nth, arg_min(why, rule) AS why FROM context_hits GROUP BY ALL) h USING (doc_id, page, nth)
          WHERE NOT EXISTS (FROM rare_text_flags f WHERE f.doc_id = s.doc_id AND f.page = s.page AND f.box = s.box)""",
    ),
    "tile_ranks": (("tile_scores",), "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y, x)::INT AS rank, count(*) OVER (PARTITION BY image_id) AS n FROM tile_scores"),
}

_FLAGS = {
    "text_dates": "date_flags", "mixed_dates": "mixed_flags", "swapped_dates": "swapped_flags", "edit_tool_meta": "pdf_flags", "exif_checks": "exif_flags", "split_font_words": "split_flags",
    "rare_number_font": "rare_number_flags", "rare_text_font": "rare_text_flags", "font_count": "font_count_flags", "font_context": "context_flags", "hidden_text": "hidden_flags", "overlay_text": "overlay_flags",
    "robust_z_heights": "height_flags", "low_conf_numbers": "low_conf_flags", "ela_outliers": "ela_flags", "number_formats": "number_flags", "decimal_mode": "decimal_flags",
    "row_arithmetic": "row_flags", "invoice_totals": "total_flags", "lenient_totals": "lenient_flags", "due_date_logic": "due_flags",
}
_ALL = ["pdf_flags", "exif_flags", "split_flags", "rare_number_flags", "rare_text_flags", "font_count_flags", "hidden_flags", "overlay_flags", "ela_flags", "height_flags", "low_conf_flags", "date_flags", "number_flags", "decimal_flags", "plain_mixed_flags", "row_flags", "total_flags", "due_flags"]
_COLUMNS = "doc_id, page, field, reason, severity, check_name, box, marker"
_WEIGHT = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 3 ELSE 6 END"


def _with(names: list[str], select: str) -> str:
    """A statement with the parts and views that it needs, in order."""
    parts: list[str] = []
    views: list[str] = []

    def add(name: str) -> None:
        if name in _PARTS:
            for x in _PARTS[name][0]:
                add(x)
            if name not in parts:
                parts.append(name)
        elif name not in views:
            views.append(name)

    for n in names:
        add(n)
    ctes = [duckdb_views(views)] if views else []
    shared = lambda n: "" if n in ("placed", "in_rows", "in_columns") else "MATERIALIZED "
    return "WITH RECURSIVE " + ",\n".join([*ctes, *[f"{n} AS {shared(n)}({_PARTS[n][1]})" for n in parts]]) + "\n" + select


def _with_views(views: list[str], select: str) -> str:
    return "WITH " + duckdb_views(views) + "\n" + select


_UNION = " UNION ALL ".join(f"SELECT {_COLUMNS} FROM {n}" for n in _ALL)
_VERDICT = f"""SELECT doc_id, coalesce(risk_score, 0)::BIGINT AS risk_score, coalesce(n_flags, 0)::BIGINT AS n_flags, coalesce(strong_checks, 0)::BIGINT AS strong_checks,
  CASE WHEN strong_checks >= 2 OR risk_score >= 12 THEN 'LIKELY TAMPERED' WHEN strong_checks > 0 THEN 'SUSPICIOUS' ELSE 'NO STRONG SIGNS OF TAMPERING' END AS verdict
  FROM (SELECT DISTINCT o_orderkey AS doc_id FROM orders) LEFT JOIN (SELECT doc_id AS d, sum({_WEIGHT}) AS risk_score, count(*) AS n_flags, count(DISTINCT check_name) FILTER (severity <> 'low') AS strong_checks FROM ({_UNION}) GROUP BY doc_id) ON d = doc_id"""

ORACLE_SQL: dict[str, str] = {name: _with([part], f"SELECT {_COLUMNS} FROM {part}") for name, part in _FLAGS.items()}
ORACLE_SQL |= {
    "token_classify": _with(
        ["tok"],
        r"""SELECT doc_id, word_no, c AS cleaned, num AS numeric_token, money AS money_token, CASE WHEN num THEN val END AS number_value,
          regexp_full_match(c, '[\dOolISBZ,.]{3,}') AND len(regexp_extract_all(c, '\d')) > 0 AND len(regexp_extract_all(c, '[OolISBZ]')) > 0 AND len(regexp_extract_all(c, '\d')) / length(c) >= 0.5 AS lookalike,
          c LIKE '%,%' AND num AND length(c) >= 5 AND NOT regexp_full_match(regexp_replace(regexp_replace(c, '^[$₹€£]+', ''), '%+$', ''), '\d{1,3}(,\d{3})+(\.\d+)?|\d{1,2}(,\d{2})+,\d{3}(\.\d+)?') AS bad_thousands,
          CASE WHEN num AND c LIKE '%.%' THEN length(string_split(regexp_replace(c, '%+$', ''), '.')[-1]) ELSE -1 END::INT AS places, kw AS keyword, len(regexp_extract_all(text, '[\p{L}\p{N}]'))::INT AS alnum FROM tok""",
    ),
    "pdf_date_parse": _with(["pdf_dates"], "SELECT doc_id, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified FROM pdf_dates"),
    "font_family_norm": _with(["spans"], r"SELECT font, lower(regexp_replace(regexp_replace(font, '^[A-Z]{6}\+', ''), '([-_, ]?(bold|italic|oblique|black|semibold|demi|medium|light|regular|roman|mt|ps))+$', '', 'i')) AS family, count(*) AS n_spans FROM spans GROUP BY ALL"),
    "box_union": _with(["tok"], "SELECT doc_id, page, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1)::INT AS line_no, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM tok GROUP BY doc_id, page, tok.line_no"),
    "robust_z": _with(["ela_z"], "SELECT doc_id, word_no, round(0.6745 * (ela - med) / coalesce(nullif(median(abs(ela - med)) OVER (PARTITION BY doc_id, page), 0), 1e-6), 5) AS z, med AS median, n FROM (SELECT *, median(ela) OVER (PARTITION BY doc_id, page) AS med, count(*) OVER (PARTITION BY doc_id, page) AS n FROM ela_scores)"),
    "robust_z_corpus": _with(["ela_scores"], "SELECT doc_id, page, word_no, round(0.6745 * (ela - median) / coalesce(nullif(median(abs(ela - median)) OVER (PARTITION BY page), 0), 1e-6), 5) AS z, median, n FROM (SELECT *, median(ela) OVER (PARTITION BY page) AS median, count(*) OVER (PARTITION BY page) AS n FROM ela_scores)"),
    "line_grouping": _with(
        ["placed"],
        """SELECT doc_id, page, word_no, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY top, grp) - 1)::INT AS line_no, (row_number() OVER (PARTITION BY doc_id, page, grp ORDER BY x, i) - 1)::INT AS pos, text
          FROM (SELECT w.*, grp, min(y) OVER (PARTITION BY w.doc_id, w.page, grp) AS top FROM in_order w JOIN placed p ON p.doc_id = w.doc_id AND p.page = w.page AND p.i = w.i)""",
    ),
    "split_label_merge": _with(["merged", "ln"], "SELECT doc_id, page, n AS line_no, m.line_text FROM merged m JOIN (SELECT doc_id, page, line_no, (row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1)::INT AS n FROM ln) r USING (doc_id, page, line_no)"),
    "risk_verdict": _with(_ALL, _VERDICT),
    "document_risk_report": _with(_ALL, f"SELECT doc_id, 'in/doc.v1/' || doc_id || '.pdf' AS file, risk_score, verdict, n_flags::INT AS n_flags, 'in/doc.v1/' || doc_id || '_tamper_report.json' AS report_file FROM ({_VERDICT})"),
    "report_lines": _with(
        ["pdf_flags", "low_conf_flags"],
        f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {_WEIGHT} DESC, seq, word_no)::INT AS rank, '[' || rpad(upper(severity), 6, ' ') || '] p' || page || ' (' || check_name || ') ''' || field || ''': ' || reason AS line FROM (
          SELECT *, CASE WHEN reason LIKE 'Producer%' THEN 0 WHEN reason LIKE 'Modified%' THEN 1 WHEN reason LIKE 'Metadata%' THEN 2 WHEN reason LIKE '%EOF%' THEN 3 ELSE 4 END AS seq, 0 AS word_no FROM pdf_flags UNION ALL SELECT {_COLUMNS}, 9, word_no FROM low_conf_flags)""",
    ),
    "annotation_boxes": _with(
        ["low_conf_flags", "rare_number_flags"],
        f"""SELECT doc_id, page, marker, 'in/doc.v1/' || doc_id || '_annotated.png' AS annotated_file, (b[1] - pad)::INT AS x_left, (b[2] - pad)::INT AS y_top, (b[1] + b[3] + pad)::INT AS x_right, (b[2] + b[4] + pad)::INT AS y_bottom,
          CASE WHEN marker = 'yellow' THEN 150 ELSE 110 END AS alpha, CASE WHEN marker = 'yellow' THEN '255,214,0' ELSE '255,0,0' END AS rgb FROM (
          SELECT *, string_split(box, ',')::INT[] AS b, CASE WHEN marker = 'yellow' THEN 4 ELSE 3 END AS pad FROM (SELECT {_COLUMNS} FROM low_conf_flags UNION ALL SELECT {_COLUMNS} FROM rare_number_flags))""",
    ),
    "tile_grid": _with(
        ["image_sizes"],
        """SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1)::INT AS tile_no, x, y FROM (
          SELECT image_id, unnest(xs)::INT AS x, y FROM (SELECT image_id, xs, unnest(ys)::INT AS y FROM (
            SELECT image_id, list_distinct(list_append(range(0, greatest(width - 224, 0) + 1, 168), greatest(width - 224, 0))) AS xs, list_distinct(list_append(range(0, greatest(height - 224, 0) + 1, 168), greatest(height - 224, 0))) AS ys FROM image_sizes)))""",
    ),
    "tile_top10": _with(["tile_ranks"], "SELECT image_id, rank, x, y, score FROM tile_ranks WHERE rank <= 10"),
    "photo_decision": _with(
        ["tile_ranks"],
        """SELECT *, CASE WHEN decision = 'Fake Image Detected' THEN 'MANIPULATION SUSPECTED' ELSE decision END AS prototype_decision, decision = 'MANIPULATION SUSPECTED' AS is_suspicious_ref, decision IN ('MANIPULATION SUSPECTED', 'Fake Image Detected') AS is_suspicious, format('{:.2f}', round(maximum_ai_score, 6) * 100) || '%' AS maximum_shown FROM (
          SELECT image_id, count(*) AS total_tiles, round(avg(score), 6) AS average_ai_score, max(score) AS maximum_ai_score, round(avg(score) FILTER (rank <= greatest(1, floor(n * 0.1))), 6) AS top_10_average, count(*) FILTER (score >= 0.8) AS suspicious_tile_count,
            CASE WHEN max(score) >= 0.95 THEN 'Fake Image Detected' WHEN avg(score) FILTER (rank <= greatest(1, floor(n * 0.1))) >= 0.75 THEN 'MANIPULATION SUSPECTED' WHEN avg(score) >= 0.5 THEN 'REVIEW' ELSE 'LIKELY REAL' END AS decision FROM tile_ranks GROUP BY image_id)""",
    ),
    "softmax_scores": """SELECT vec_id, (generate_subscripts(p, 1) - 1)::INT AS i, round(unnest(p), 8) AS probability FROM (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE)) AS e FROM embeddings))""",
}
ORACLE_SQL |= {
    "patch_means": _with_views(
        ["pixels", "pixel_boxes"],
        """SELECT box_id, count(*) AS pixels, round(avg(v::DOUBLE), 6) AS mean FROM pixel_boxes b JOIN pixels p ON b.page = p.page AND p.x >= b.x AND p.x < b.x + b.w AND p.y >= b.y AND p.y < b.y + b.h GROUP BY box_id""",
    ),
    "shown_values": """SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7, 6) AS price, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END AS flag, round_even(l_tax / 3, 6) AS part, 2 AS n_parts,
      round_even(l_discount / 9, 6) AS share, format('{:.2f}%', l_discount * 100) AS risk_shown, CASE WHEN l_quantity <= 1 THEN format('{:.2f}%', l_quantity * 100) ELSE format('{:.2f}%', l_quantity) END AS score_shown FROM lineitem""",
    "label_scores": """SELECT doc_id, label, round(coalesce(length(label) / 20, 0), 6) AS score FROM (
      SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' ')[1:30], lambda v: regexp_matches(lower(v), 'ai|fake|synthetic'))[1] AS label FROM documents)""",
    "file_names": r"""SELECT page_id, lower(regexp_extract(url, '\.([^./\\]*)$', 1)) AS ext, list_contains(['jpg', 'jpeg', 'png', 'webp', 'bmp', 'tiff', 'tif', 'pdf'], lower(regexp_extract(url, '\.([^./\\]*)$', 1))) AS allowed,
      regexp_replace(url, '^(\w+:)/+', '\1/') AS plain, regexp_replace(url, '([^/\\])\.[^./\\]*$', '\1') AS stem FROM pages""",
}
