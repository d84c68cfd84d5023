"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from roadlens.llm.licenses import LEAST_CONTAINMENT, TEMPLATES, template_shingles
from roadlens.llm.quality import Rules
from roadlens.llm.vector_codes import Settings


def _quality(rules: Rules = Rules()) -> str:
    """Counts by unnesting words and windows; quartiles as the value at rank ceil(q * n)."""
    features = {f.feature: f for f in rules.fences}

    def quartile(name: str, q: float, rows: str) -> str:
        return f"list_sort(list({name}))[greatest(1, ceil({q} * count(*)))::BIGINT] AS {rows}_{name}_{int(q * 100)}"

    both = lambda level: ", ".join(quartile(n, q, level) for n in features for q in (0.25, 0.75))
    chosen = lambda n, q: (f"CASE WHEN g.n >= {rules.least_group} THEN g.g_{n}_{q} WHEN l.n >= {rules.least_group} "
                           f"THEN l.l_{n}_{q} ELSE a.a_{n}_{q} END")
    inside = []
    for n, f in features.items():
        spread = f"greatest({chosen(n, 75)} - {chosen(n, 25)}, {f.least_spread}) * {f.reach}"
        inside.append(f"(p.{n} <= {chosen(n, 75)} + {spread})")
        if f.lower:
            inside.append(f"(p.{n} >= {chosen(n, 25)} - {spread})")
    return fr"""
WITH numbered AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS x FROM numbered),
starts AS (SELECT k, i, array_to_string(w[i : i + 7], ' ') AS s FROM tokens, unnest(range(1, len(w) - 6)) AS t(i)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM starts) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM again, range(8) AS r(j) GROUP BY k),
counts AS (SELECT t.k, doc_id, lang, source, len(w) AS n_words,
                  length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) AS word_chars,
                  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                  len(x) - len(list_distinct(x)) AS n_dup_lines, len(x) AS n_lines,
                  coalesce(c.n, 0) AS n_repeat_words
           FROM tokens t LEFT JOIN covered c USING (k)),
based AS (SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeated_pct} * n_words AS base_failed FROM counts),
passed AS (SELECT *, n_symbols / word_chars AS symbol_share, n_dup_lines / n_lines AS dup_line_share,
                  n_repeat_words / n_words AS repeat_share, word_chars / n_words AS word_length
           FROM based WHERE NOT base_failed),
g AS (SELECT lang, source, count(*) AS n, {both('g')} FROM passed GROUP BY lang, source),
l AS (SELECT lang, count(*) AS n, {both('l')} FROM passed GROUP BY lang),
a AS (SELECT {both('a')} FROM passed),
good AS (SELECT k, {' AND '.join(inside)} AS ok FROM passed p
         JOIN g ON p.lang IS NOT DISTINCT FROM g.lang AND p.source IS NOT DISTINCT FROM g.source
         JOIN l ON p.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(ok, false) AS kept
FROM based LEFT JOIN good USING (k)"""


_CHAT = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
lengths AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
                   replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n') AS head FROM rows),
kinds AS (SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END,
                                     '' ORDER BY turn NULLS FIRST, role, text) AS kinds FROM rows GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  regexp_full_match(any_value(kinds), 's?u(au)*a?') AS valid
FROM lengths JOIN kinds USING (conv_id) GROUP BY conv_id"""


def _merkle() -> str:
    def printed(column: str) -> str:
        """Paragraphs, their leaves, and the string of one text column."""
        leaves = "regexp_extract_all(p, '(?s).{1,32}')"
        nodes = (f"list_transform(string_split({column}, chr(10)), lambda p: {{'l': list_transform({leaves}, lambda b: md5(b)), "
                 f"'d': md5(array_to_string(list_transform({leaves}, lambda b: md5(b)), ''))}})")
        end = "CASE WHEN p.d[1] < '4' THEN ';' ELSE ',' END"
        sections = f"string_split(array_to_string(list_transform(nodes, lambda p: p.d || {end}), ''), ';')"
        short = f"array_to_string(list_transform(nodes, lambda p: array_to_string(list_transform(p.l, lambda d: d[1:6]), '') || {end}), '')"
        return nodes, f"md5(array_to_string(list_transform({sections}, lambda s: md5(s)), '')) || ':' || {short}"
    nodes, string = printed("text")
    edited_nodes, _ = printed("edited")
    leaves = lambda fp: f"list_distinct(regexp_extract_all(split_part({fp}, ':', 2), '[0-9a-f]{{6}}'))"
    near = lambda a, b: (f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({leaves(a)}, {leaves(b)})) "
                         f"/ greatest(1, len({leaves(a)}) + len({leaves(b)})) END")
    return f"""
WITH ordered AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS k, doc_id, coalesce(text, '') AS text FROM documents),
following AS (SELECT *, coalesce(lead(text) OVER (ORDER BY k), first(text) OVER (ORDER BY k)) AS following FROM ordered),
changed AS (SELECT k, doc_id, text, text[1 : length(text) - length(text) // 2] || following[1 : length(text) // 2] AS edited FROM following),
own AS (SELECT k, doc_id, text, edited, {nodes} AS nodes, {edited_nodes} AS edited_nodes FROM changed),
printed AS (SELECT k, doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {string} AS fingerprint,
                   {string.replace('nodes', 'edited_nodes')} AS edited_fingerprint FROM own),
pairs AS (SELECT *, coalesce(lead(fingerprint) OVER (ORDER BY k), first(fingerprint) OVER (ORDER BY k)) AS next_fp FROM printed)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {near('fingerprint', 'edited_fingerprint')} AS near_edited, {near('fingerprint', 'next_fp')} AS near_next,
       len(list_distinct(missing))::BIGINT AS edited_sections, list_min(places)::BIGINT AS first_edited, list_max(places)::BIGINT AS last_edited
FROM (SELECT *, list_filter(own, lambda s: NOT list_contains(other, s)) AS missing,
             list_transform(list_filter(own, lambda s: NOT list_contains(other, s)), lambda s: list_position(own, s)) AS places
      FROM (SELECT *, string_split(split_part(fingerprint, ':', 2), ';') AS own, string_split(split_part(edited_fingerprint, ':', 2), ';') AS other FROM pairs))"""


def _licenses() -> str:
    """Every template against every text, by unnested shingles."""
    quoted = lambda parts: "[" + ", ".join("'" + p + "'" for p in parts) + "]"
    notices = ", ".join(f"('{name}', {quoted(template_shingles(t))})" for name, texts in TEMPLATES.items() for t in texts)
    return f"""
WITH notices(license, parts) AS (VALUES {notices}),
tokens AS (SELECT row_number() OVER () AS k, doc_id,
                  list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT k, doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM tokens, unnest(range(1, len(w) - 3)) AS t(i)),
wanted AS (SELECT n.*, p.s AS s, row_number() OVER () AS place FROM (SELECT *, row_number() OVER () AS notice FROM notices) n, unnest(parts) AS p(s)),
shares AS (SELECT k, doc_id, license, notice, count(*) / any_value(len(parts))::DOUBLE AS containment
           FROM shingles JOIN wanted USING (s) GROUP BY k, doc_id, license, notice)
SELECT doc_id, license, max(containment) AS containment FROM shares WHERE containment >= {LEAST_CONTAINMENT}
GROUP BY k, doc_id, license"""


_WARC = """
WITH sized AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
grouped AS (SELECT *, payload_bytes >= 100 AND page_id IS NOT NULL AS able FROM sized),
placed AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, able) AS lowest,
                  row_number() OVER (PARTITION BY payload_digest, able ORDER BY page_id, url NULLS FIRST) AS k FROM grouped)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN able AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN able AND k > 1 THEN lowest END AS refers_to
FROM placed"""


def _codes(settings: Settings = Settings(), part_size: int = 8) -> str:
    """Rounds written out one after another, distances component by component, quotients floored by remainder."""
    span = range(1, part_size + 1)
    far = "+".join(f"(t.v[{i}] - b.v[{i}]) * (t.v[{i}] - b.v[{i}])" for i in span)
    cut = lambda i: f"(sum(t.v[{i}]) - ((sum(t.v[{i}]) % count(*)) + count(*)) % count(*)) // count(*)"
    mean = ", ".join(f"({cut(i)})::BIGINT" for i in span)
    steps = []
    for k in range(settings.rounds + 1):
        # Distance and entry in one number, so the minimum decides ties for the lower entry.
        steps.append(f"near{k} AS MATERIALIZED (SELECT t.k, t.p, min(({far}) * {settings.entries} + b.e) AS d "
                     f"FROM parts t JOIN book{k} b USING (p) GROUP BY t.k, t.p)")
        if k < settings.rounds:
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN "
                         f"(SELECT t.p, d % {settings.entries} AS e, [{mean}] AS v FROM parts t JOIN near{k} USING (k, p) GROUP BY t.p, e) m "
                         f"ON b.p = m.p AND b.e = m.e)")
    last = settings.rounds
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label,
                  list_transform(embedding, lambda x: floor({settings.scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT k, p, x[{part_size} * p + 1 : {part_size} * p + {part_size}] AS v FROM kept, range({settings.parts}) AS r(p)),
book0 AS MATERIALIZED (SELECT p, k - 1 AS e, v FROM parts WHERE k <= {settings.entries}),
{", ".join(steps)},
coded AS (SELECT k, string_agg(format('{{:02x}}', d % {settings.entries}), '' ORDER BY p) AS code, sum(d // {settings.entries})::BIGINT AS error
          FROM near{last} GROUP BY k),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (k) CROSS JOIN books"""


SQL = {"op8_license_scan": _licenses(), "op4_quality_rules": _quality(), "op9_chat_format": _CHAT, "op10_merkle_fingerprints": _merkle(),
       "op11_vector_codes": _codes(), "op13_warc": _WARC}
