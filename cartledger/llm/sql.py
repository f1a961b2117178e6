"""The queries once more as DuckDB SQL."""

from __future__ import annotations

from cartledger.llm.codes import Coding
from cartledger.llm.licenses import NOTICES, WORD_GAP, Dice
from cartledger.llm.quality import BOILERPLATE, SENTENCE_ENDS, UNSPACED, UNSPACED_WORD, Rules

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_rules(rules: Rules = Rules()) -> str:
    low = _LOWER.format("line")
    phrases = " + ".join(
        f"(length({low}) - length(replace({low}, '{p}', ''))) // {len(p)} * {len(p.replace(' ', ''))}" for p in BOILERPLATE
    )
    blocks = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED)
    ends = "".join(c for c in SENTENCE_ENDS if c not in "]'\"") + "\"''"
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, {_WORDS.format('t')} AS w FROM docs),
three AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)
),
twice AS (SELECT doc_id, g FROM three GROUP BY doc_id, g HAVING count(*) > 1),
spots AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM three JOIN twice USING (doc_id, g)),
repeated AS (SELECT doc_id, count(DISTINCT spot) AS n FROM spots GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, no, {_WORDS.format('line')} AS lw
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM docs)
),
rated AS (
  SELECT doc_id, line, no, len(lw) AS n,
    list_sum(list_transform(lw, lambda x: length(x))) AS chars,
    len(list_filter(lw, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS symbols,
    len(list_filter(lw, lambda x: octet_length(encode(x)) > 2 AND x LIKE '%!!')) AS shouts,
    len(list_filter(lw, lambda x: regexp_full_match(x, '[|>/*-]'))) AS separators,
    length(regexp_replace(line, '[^{blocks}]', '', 'g')) // {UNSPACED_WORD} AS unspaced,
    {phrases} AS phrase_chars,
    regexp_matches(lw[-1], '[\]{ends}]$') AS closes
  FROM lines WHERE len(lw) > 0
),
verdicts AS (
  SELECT *, 100 * symbols > {rules.max_symbol_percent} * n OR 100 * shouts > {rules.max_shout_percent} * n
    OR 100 * separators > {rules.max_separator_percent} * n OR (n + unspaced < {rules.min_sentence_words} AND NOT closes)
    OR (phrase_chars > 0 AND 100 * phrase_chars >= {rules.min_phrase_percent} * chars) AS failed,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY no) > 1 AS dup
  FROM rated
),
per_doc AS (
  SELECT doc_id, count(*) FILTER (dup) AS dups, coalesce(sum(chars) FILTER (NOT failed), 0) AS kept_chars
  FROM verdicts GROUP BY doc_id
),
counted AS (
  SELECT s.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(p.dups, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(p.kept_chars, 0) AS kept_chars
  FROM split s LEFT JOIN per_doc p USING (doc_id) LEFT JOIN repeated r USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND 100 * kept_chars >= {rules.min_kept_percent} * word_chars AS kept
FROM (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS failed FROM counted)
"""


def license_scan(dice: Dice = Dice()) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in NOTICES)
    words = f"list_filter(string_split_regex({_LOWER.format('u')}, '{WORD_GAP}|\\n'), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH known AS (
  SELECT license_id, no, len(g) AS size, unnest(g) AS gram
  FROM (SELECT license_id, no, {pairs} AS g FROM (
    SELECT license_id, row_number() OVER () AS no, {words} AS w FROM (VALUES {values}) v(license_id, u)))
),
plain AS (SELECT doc_id, regexp_replace(text, '{WORD_GAP}', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, t, string_split_regex(t, '\n(?: *\n)+') AS blocks FROM plain),
listed AS (
  SELECT doc_id, string_split(t, chr(10)) || list_filter(blocks, lambda b: contains(b, chr(10)))
    || CASE WHEN len(blocks) > 1 THEN [t] ELSE [] END AS us
  FROM cut
),
units AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS unit FROM listed),
grams AS (
  SELECT doc_id, unit, len(g) AS n, unnest(g) AS gram
  FROM (SELECT doc_id, unit, {pairs} AS g FROM (SELECT doc_id, unit, {words} AS w FROM units))
),
matched AS (
  SELECT doc_id, unit, license_id, no, 2 * count(*) / (n + size) AS dice
  FROM grams JOIN known USING (gram) GROUP BY doc_id, unit, license_id, no, n, size
  HAVING 200 * count(*) >= {dice.percent} * (n + size)
),
best AS (SELECT doc_id, unit, license_id, max(dice) AS dice FROM matched GROUP BY ALL)
SELECT doc_id, license_id, max(dice) AS dice, count(*) AS n_units FROM best GROUP BY doc_id, license_id
"""


CHAT_FORMAT = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, content) - 1 AS place FROM turns
),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
views AS (
  SELECT p.conv_id, place // 512 AS part, place, perspective, content, coalesce(role = perspective, false) AS trained,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
      ELSE 'user' || coalesce(' name=' || regexp_replace(role, '[ \t\n\x0B\f\r]', '_', 'g'), '') END || chr(10) AS head
  FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
),
spots AS (
  SELECT *, coalesce(sum(length(head) + length(content) + 11) OVER (
    PARTITION BY conv_id, part, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
  FROM views
)
SELECT conv_id, part, perspective, count(*) AS n_turns, count(*) FILTER (trained) AS n_trained,
  string_agg(head || content || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered,
  coalesce(string_agg((at_ + length(head))::BIGINT || '-' || (at_ + length(head) + length(content) + 10)::BIGINT, ','
    ORDER BY place) FILTER (trained), '') AS mask
FROM spots GROUP BY conv_id, part, perspective
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS no FROM split),
keyed AS (SELECT *, {_LOWER.format(f'trim(line, {_SPACES})')} AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_LOWER_WORDS = _WORDS.format(_LOWER.format("coalesce(text, '')"))
_FIVES = """unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"""

DECONTAMINATE = rf"""
WITH held AS (SELECT DISTINCT doc_id, {_FIVES} AS g FROM (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents)),
known AS (SELECT DISTINCT item_id, {_FIVES} AS g FROM (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark)),
sizes AS (SELECT item_id, count(*) AS n_item FROM known GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM held JOIN known USING (g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE split AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, {_FIVES} AS g FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN links ON r.other = x
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


def vector_codes(coding: Coding = Coding()) -> str:
    """Every entry against every part, round by round."""
    n, entries, rounds = coding.parts, coding.entries, coding.rounds
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v,
    row_number() OVER (ORDER BY vec_id) AS no
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
  SELECT vec_id, label, no, p, v[p * (len(v) // {n}) + 1 : (p + 1) * (len(v) // {n})] AS x
  FROM kept, range({n}) t(p)
),
book0 AS MATERIALIZED (SELECT p, no - 1 AS e, x AS c FROM parts WHERE no <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""
near{i} AS MATERIALIZED (
  SELECT vec_id, label, no, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best
  FROM (
    SELECT vec_id, label, no, parts.p AS p, x, e,
      list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN book{i} b ON parts.p = b.p)
  GROUP BY vec_id, label, no, p
)"""
        )
        if i < rounds:
            steps.append(
                f"""
mean{i} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY at_) AS c
  FROM (SELECT p, best.e AS e, at_, sum(value)::HUGEINT AS s, count(*) AS n
    FROM (SELECT p, best, unnest(x) AS value, generate_subscripts(x, 1) AS at_ FROM near{i}) GROUP BY p, best.e, at_)
  GROUP BY p, e
),
book{i + 1} AS MATERIALIZED (
  SELECT b.p AS p, b.e AS e, coalesce(m.c::BIGINT[], b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e
)"""
            )
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT vec_id, label, no, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id, label, no
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded
"""


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# The decimal id's CRC-32, a bit at a time: each byte goes in, then eight shifts.
_CRC32 = """xor(4294967295, list_reduce(
    [4294967295] || flatten(list_transform(string_split({0}::VARCHAR, ''), lambda c: [ord(c)::BIGINT] || [-1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"""


def merkle_manifest() -> str:
    """All levels of the sources' trees, then of the tree over them, then each leaf's way up."""
    proof = "array_to_string(run[:(r.pos % 16)::INT], '') || array_to_string(run[(r.pos % 16 + 2)::INT:], '')"
    fold = "sha256(array_to_string(run[:(r.pos % 16)::INT], '') || r.folded || array_to_string(run[(r.pos % 16 + 2)::INT:], ''))"

    def tree(name: str, start: str) -> str:
        return f"""
{name}(tree, level, pos, n, digest) AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 16, n
),
{name}_runs AS MATERIALIZED (SELECT tree, level, pos // 16 AS parent, list(digest ORDER BY pos) AS run FROM {name} WHERE n > 1 GROUP BY ALL)"""

    def way(name: str, start: str, nodes: str) -> str:
        return f"""
{name}(no, tree, level, pos, proof, folded) AS (
  {start}
  UNION ALL
  SELECT r.no, r.tree, r.level + 1, r.pos // 16, r.proof || {proof}, {fold}
  FROM {name} r JOIN {nodes}_runs u ON u.tree = r.tree AND u.level = r.level AND u.parent = r.pos // 16
)"""

    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
    CASE WHEN {_CRC32.format('doc_id')} % 5 = 0 THEN {_leaf(_LOWER.format('text'))} END AS tampered,
    row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS no,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM documents
),
{tree('lower_nodes', 'SELECT tree, 0::BIGINT, pos, n, leaf FROM leaves')},
subroots AS MATERIALIZED (SELECT tree, digest FROM lower_nodes WHERE n = 1),
{tree('upper_nodes', 'SELECT 0::BIGINT, 0::BIGINT, tree, (SELECT count(*) FROM subroots), digest FROM subroots')},
top AS (SELECT digest AS root FROM upper_nodes WHERE n = 1),
{way('to_subroot', "SELECT no, tree, 0::BIGINT, pos, '', coalesce(tampered, leaf) FROM leaves", 'lower_nodes')},
at_subroot AS MATERIALIZED (SELECT no, tree, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM to_subroot GROUP BY no, tree),
{way('to_root', 'SELECT no, 0::BIGINT, 0::BIGINT, tree, proof, folded FROM at_subroot', 'upper_nodes')},
at_root AS (SELECT no, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM to_root GROUP BY no)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN subroots s USING (tree) JOIN at_root USING (no) CROSS JOIN top
"""


EMBEDDING_DEDUP = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, y FROM reach r JOIN links ON r.other = x
),
named AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degrees AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN degrees USING (vec_id)
"""


def texts() -> dict[str, str]:
    return {
        "op1_decontaminate": DECONTAMINATE,
        "op6_quality_rules": quality_rules(),
        "op7_license_scan": license_scan(),
        "op8_chat_format": CHAT_FORMAT,
        "op9_line_dedup": LINE_DEDUP,
        "op10_ngram_jaccard": NGRAM_JACCARD,
        "op11_vector_codes": vector_codes(),
        "op12_merkle_manifest": merkle_manifest(),
        "op13_embedding_dedup": EMBEDDING_DEDUP,
    }
