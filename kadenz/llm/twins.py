"""DuckDB SQL for the queries of operators 11 to 13."""

from __future__ import annotations

from kadenz.llm.chat_format import CONTROL, ESCAPABLE, LOSS_ROLE, PLANTED
from kadenz.llm.merkle import FANOUT

#: The table of the CRC-32 with polynomial 0xEDB88320, as one row with a list.
_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) r(i)))"


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; the table `crc` must be in scope."""
    code = f"hex(encode({text}))"
    octets = f"list_transform(range(1, strlen({code}), 2), lambda p: ('0x' || {code}[p:p + 1])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def importance(buckets: int, percent: int, least: int, seed: int) -> str:
    """Twin of op11: features are counted before their CRC is worked out."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = " UNION ALL ".join(f"SELECT d, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS f FROM {{0}} WHERE len(ws) >= {n}" for n in (1, 2, 3))
    return f"""
        WITH {_CRC_TABLE},
        a AS (SELECT row_number() OVER () AS d, doc_id, {words} AS ws FROM documents), b AS (SELECT 0 AS d, {words} AS ws FROM benchmark),
        fa AS (SELECT d, f, count(*) AS n FROM ({runs.format("a")}) GROUP BY ALL), fb AS (SELECT f, count(*) AS n FROM ({runs.format("b")}) GROUP BY f),
        hashed AS (SELECT f, {_crc("f")} % {buckets} AS bucket FROM (SELECT f FROM fa UNION SELECT f FROM fb), crc),
        s AS (SELECT bucket, sum(n) AS n FROM fa JOIN hashed USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM fb JOIN hashed USING (f) GROUP BY bucket),
        k AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
        gains AS (SELECT h.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (k.s + {buckets})) / ((coalesce(s.n, 0) + 1)::DOUBLE * (k.t + {buckets}))))::BIGINT AS gain
            FROM (SELECT DISTINCT bucket FROM hashed) h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), k),
        w AS (SELECT d, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM fa JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY d),
        sc AS (SELECT a.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM a LEFT JOIN w USING (d)),
        r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {least} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS nth, count(*) OVER (PARTITION BY n_words >= {least}) AS n FROM sc)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {least} AND nth <= {percent} * n // 100 THEN nth END AS rank FROM r
    """


def chats() -> str:
    """Twin of op12: what is read back is what went in; only the formatted length depends on the template."""
    shown = {k: f"length('{v}')" for k, v in CONTROL.items()}
    escaped = lambda c: f"length(regexp_replace({c}, '{ESCAPABLE}', '<\\\\\\1|\\2|>', 'g'))"
    said = f"text ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}')"
    return f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, '{LOSS_ROLE}', '{PLANTED}'),
        g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(string_agg({said.replace("text ORDER", "text, '' ORDER")}, '') AS said, sum({shown["start"]} + {escaped("role")} + {shown["middle"]} + {escaped("text")} + {shown["end"]}) AS formatted_chars FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(said) AS loss_chars, sha256(said) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
    """


def manifest() -> str:
    """Twin of op13: the levels by recursion, then a walk from each leaf up through its subroot to the root."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text])) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    up = f"SELECT lvl + 1, grp, pos // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {{0}}) WHERE n > 1 GROUP BY lvl, grp, pos // {FANOUT}"
    around = f"""SELECT a.lvl, a.grp, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS ahead, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
        FROM (SELECT *, count(*) OVER (PARTITION BY lvl, grp) AS n FROM {{0}}) a JOIN {{0}} b ON a.lvl = b.lvl AND a.grp IS NOT DISTINCT FROM b.grp AND a.pos // {FANOUT} = b.pos // {FANOUT} WHERE n > 1 GROUP BY a.lvl, a.grp, a.pos"""
    walk = f"SELECT d, w.lvl + 1, w.grp, w.pos // {FANOUT}, proof || ahead || behind, sha256(ahead || folded || behind) FROM {{0}} w JOIN {{1}} s ON w.lvl = s.lvl AND w.grp IS NOT DISTINCT FROM s.grp AND w.pos = s.pos"
    return f"""
        WITH RECURSIVE {_CRC_TABLE},
        l AS (SELECT row_number() OVER () AS d, doc_id, source, {leaf("text")} AS leaf, CASE WHEN {_crc("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(lower)} END AS other FROM documents, crc),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
        lv(lvl, grp, pos, h) AS (SELECT 0, source, pos, leaf FROM p UNION ALL {up.format("lv")}),
        sub AS (SELECT grp AS source, h AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS nth FROM (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY grp ORDER BY lvl DESC) = 1)),
        cr(lvl, grp, pos, h) AS (SELECT 0, 0, nth, subroot FROM sub UNION ALL {up.format("cr")}),
        root AS (SELECT h AS root FROM cr ORDER BY lvl DESC LIMIT 1), s1 AS ({around.format("lv")}), s2 AS ({around.format("cr")}),
        w1(d, lvl, grp, pos, proof, folded) AS (SELECT d, 0, source, pos, '', coalesce(other, leaf) FROM p UNION ALL {walk.format("w1", "s1")}),
        e1 AS (SELECT * FROM w1 QUALIFY row_number() OVER (PARTITION BY d ORDER BY lvl DESC) = 1),
        w2(d, lvl, grp, pos, proof, folded) AS (SELECT d, 0, 0, nth, proof, folded FROM e1 JOIN sub ON e1.grp IS NOT DISTINCT FROM sub.source UNION ALL {walk.format("w2", "s2")}),
        e2 AS (SELECT * FROM w2 QUALIFY row_number() OVER (PARTITION BY d ORDER BY lvl DESC) = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source JOIN e2 USING (d), root
    """
