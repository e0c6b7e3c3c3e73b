"""SQL that makes the Merkle manifest, its proofs and folded roots in DuckDB: trees by levels, six for sources and four above them."""

from __future__ import annotations

_SOURCE_LEVELS, _TOP_LEVELS = 6, 4


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR))::VARCHAR || ':' || CAST({c} AS VARCHAR) END"


def _levels(name: str, levels: int) -> list[str]:
    """Views name0r, name1, ...: the runs of each level and the nodes above them."""
    out = []
    for i in range(levels):
        out.append(f"{name}{i}r AS (SELECT tree, pos // 16 AS pos, max(n) AS n, string_agg(digest, '' ORDER BY pos) AS run FROM {name}{i} GROUP BY tree, pos // 16)")
        out.append(f"{name}{i + 1} AS (SELECT tree, pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS digest FROM {name}{i}r)")
    return out


def _folds(start: str, name: str, levels: int, tree: str) -> list[str]:
    """Views start_0, start_1, ...: one more level of siblings in the proof, and the node folded over them."""
    out, last = [], start
    for i in range(levels):
        k = f"(64 * ((x.{name}pos // {16**i}) % 16))::BIGINT"
        left, right = f"substr(run, 1, {k})", f"substr(run, {k} + 65)"
        out.append(
            f"{start}_{i} AS (SELECT x.* EXCLUDE (proof, folded), proof || CASE WHEN r.n > 1 THEN {left} || {right} ELSE '' END AS proof, "
            f"CASE WHEN r.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded FROM {last} x JOIN {name}{i}r r ON r.tree = {tree} AND r.pos = x.{name}pos // {16 ** (i + 1)})"
        )
        last = f"{start}_{i}"
    return out


def manifest_sql() -> str:
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)"
    crc32 = f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    own = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "low"))
    views = [
        f"crc(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, {step} FROM crc WHERE k < 8)",
        "crcs AS (SELECT list(c ORDER BY i) AS tab FROM crc WHERE k = 8)",
        "lowered AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)",
        f"hashed AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({own}) AS digest, CASE WHEN {crc32} % 5 = 0 THEN sha256({tampered}) END AS changed FROM lowered, crcs)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed)",
        *_levels("a", _SOURCE_LEVELS),
        f"b0 AS (SELECT '' AS tree, tree AS source, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a{_SOURCE_LEVELS})",
        *_levels("b", _TOP_LEVELS),
        "w AS (SELECT a.doc_id, a.tree, a.digest AS leaf, b.digest AS subroot, a.pos AS apos, b.pos AS bpos, '' AS proof, coalesce(a.changed, a.digest) AS folded FROM a0 a JOIN b0 b ON b.source = a.tree)",
        *_folds("w", "a", _SOURCE_LEVELS, "x.tree"),
        f"v AS (SELECT * FROM w_{_SOURCE_LEVELS - 1})",
        *_folds("v", "b", _TOP_LEVELS, "''"),
        f"top AS (SELECT digest AS root FROM b{_TOP_LEVELS})",
    ]
    return "WITH RECURSIVE " + ",\n".join(views) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM v_{_TOP_LEVELS - 1}, top\n"
