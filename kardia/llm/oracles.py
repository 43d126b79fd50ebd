"""DuckDB SQL of document operators that SQL can express but whose text is long."""

from __future__ import annotations

# FIXED VALUE: the reversed polynomial of CRC-32
CRC_TABLE = """(SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"""


def crc32(bytes_list: str) -> str:
    """CRC-32 of a list of bytes; ``crc_table`` must be a column in reach."""
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_list}), lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])), 4294967295)"


def _encoded(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _tree(leaves: str, name: str, levels: int) -> tuple[str, str]:
    """CTEs that fold ``leaves(tree, i, c, h)``: level by level ``name<l>(tree, i, c, h)`` and runs ``name<l>_runs(tree, i, c, hs)``; and the last level's name."""
    out, cur = [], leaves
    for j in range(levels):
        out.append(f"{name}{j}_runs AS (SELECT tree, i // 3 AS i, c, list(h ORDER BY i) AS hs FROM {cur} GROUP BY tree, i // 3, c)")
        out.append(f"{name}{j} AS (SELECT tree, i, (c + 2) // 3 AS c, CASE WHEN c > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}{j}_runs)")
        cur = f"{name}{j}"
    return ",\n".join(out), cur


def _fold(rows: str, name: str, levels: int, key: str, rank: str) -> tuple[str, str]:
    """CTEs that carry ``fold`` and ``sib`` of ``rows`` up the levels of a tree."""
    out, cur = [], rows
    for j in range(levels):
        at = f"((r.{rank} // {3 ** j}) % 3)"
        left, right = f"array_to_string(t.hs[1:{at}], '')", f"array_to_string(t.hs[{at} + 2:], '')"
        out.append(f"""{name}_fold{j} AS (SELECT r.* REPLACE (
  CASE WHEN t.c > 1 THEN sha256(concat({left}, r.fold, {right})) ELSE r.fold END AS fold,
  CASE WHEN t.c > 1 THEN concat(r.sib, {left}, {right}) ELSE r.sib END AS sib)
  FROM {cur} r JOIN {name}{j}_runs t ON t.tree = r.{key} AND t.i = r.{rank} // {3 ** (j + 1)})""")
        cur = f"{name}_fold{j}"
    return ",\n".join(out), cur


def merkle(levels: int = 16, source_levels: int = 16) -> str:
    """Trees of up to 3 ** levels leaves."""
    leaf = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
    digits = "list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT))"
    up, last = _tree("nodes", "t", levels)
    tops, root = _tree("sources", "s", source_levels)
    folds, folded = _fold("proofs", "t", levels, "tree", "i")
    top_folds, done = _fold("above", "s", source_levels, "one", "si")
    return f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({leaf} || {_encoded('text')}) AS leaf,
  sha256({leaf} || {_encoded("replace(text, chr(10), '')")}) AS forged, {crc32(digits)} % 2 = 0 AS even FROM documents, {CRC_TABLE}),
proofs AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY tree) AS c, CASE WHEN even THEN forged ELSE leaf END AS fold, '' AS sib FROM d),
nodes AS (SELECT tree, i, c, leaf AS h FROM proofs),
{up},
sources AS (SELECT 0 AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS c, h FROM {last}),
{tops},
{folds},
above AS (SELECT f.* EXCLUDE (i, c), 0 AS one, s.i AS si, s.h AS subroot FROM {folded} f JOIN sources s ON s.name = f.tree),
{top_folds}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = r.h AS verified
FROM {done}, (SELECT h FROM {root}) r"""


WINDOWS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT r, i, w[i:i + 34] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT k FROM wins GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS place FROM wins WHERE k IN (SELECT k FROM again)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def variants() -> str:
    """Near words by what is left when one letter is deleted: at the same place of both (replaced), or of the longer one only."""
    text = "doc_id || ':' || run"
    bytes_list = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))"
    letters = chr(0xC0) + "-" + chr(0xFF)
    return f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z{letters}]+')) AS run FROM documents)
  GROUP BY ALL),
sums AS (SELECT run, k, {crc32(bytes_list)} AS h FROM runs, {CRC_TABLE}),
counts AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM sums)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM counts)),
near AS (SELECT DISTINCT * FROM (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN counts b ON a.rest = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN counts b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
forms AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM counts c LEFT JOIN best USING (word)),
follow AS (SELECT word, word AS root FROM forms
  UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL),
ends AS (SELECT f.word, f.root FROM follow f JOIN forms g ON g.word = f.root WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
