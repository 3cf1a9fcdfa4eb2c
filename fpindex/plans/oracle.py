"""Oracle SQL of the registered queries, for DuckDB."""

from __future__ import annotations

from fpindex.plans.fixtures import BASE_TIME, NOW

# The fixture views of ``fpindex.plans.fixtures``.
VIEWS = f"""
WITH files AS (
    SELECT doc_id AS fileid,
           CAST(substr(source, 4) AS BIGINT) AS storage,
           concat('files/', lang, '/doc_', doc_id,
                  CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt'
                                  WHEN 2 THEN '.md' ELSE '.jpg' END) AS path,
           concat('doc_', doc_id,
                  CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt'
                                  WHEN 2 THEN '.md' ELSE '.jpg' END) AS name,
           n_chars AS size,
           {BASE_TIME} + doc_id * 60 AS mtime,
           CASE WHEN doc_id % 3 <> 0
                THEN concat('SHA1:', sha1(text), ' MD5:', md5(text)) END AS checksum
    FROM documents),
storages AS (
    SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS numeric_id,
           CASE WHEN CAST(substr(source, 4) AS BIGINT) % 5 = 0
                    THEN concat('local::/mnt/data/', source)
                WHEN CAST(substr(source, 4) AS BIGINT) % 7 = 3
                    THEN concat('object::store:', source)
                ELSE concat('home::', source) END AS id
    FROM documents),
owners AS (
    SELECT numeric_id, id,
           CASE WHEN starts_with(id, 'home::') THEN substr(id, 7)
                WHEN starts_with(id, 'local::') THEN regexp_extract(id, '[^/]*$')
                ELSE id END AS owner
    FROM storages),
owned AS (
    SELECT f.*, o.id AS storage_id, o.owner
    FROM files f JOIN owners o ON f.storage = o.numeric_id),
state AS (
    SELECT l.doc_id AS file_id,
           {BASE_TIME} + l.doc_id * 60 + CASE WHEN quality = 1 THEN 10 ELSE -10 END AS updated_at,
           CASE WHEN toxic = 1 THEN 'force' WHEN quality = 0 THEN 'new' WHEN lang = 'de' THEN 'auto'
                WHEN lang = 'fr' THEN 'missing' WHEN lang = 'es' THEN 'lazy' END AS pending_mode
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
idx AS (
    SELECT doc_id AS file_id, 'sha1' AS algo, sha1(text) AS hash FROM documents
    UNION ALL SELECT doc_id, 'md5', md5(text) FROM documents
    UNION ALL SELECT doc_id, 'sha256', sha256(text) FROM documents),
recorded AS (
    SELECT doc_id AS file_id, 'sha1' AS algo, sha1(text) AS hash FROM documents
    UNION ALL SELECT doc_id, 'md5', md5(text) FROM documents WHERE lang <> 'de'
    UNION ALL SELECT doc_id, 'sha256', sha256(text) FROM documents WHERE n_chars > 1000),
content AS (
    SELECT doc_id AS file_id,
           CASE WHEN source = 'src3' THEN concat(text, ' (edited)')
                WHEN source = 'src7' THEN NULL ELSE text END AS content
    FROM documents),
packed AS (
    SELECT doc_id AS file_id, 'sha1' AS algo, sha1(text) AS hash FROM documents WHERE doc_id % 3 <> 0
    UNION ALL SELECT doc_id, 'md5', md5(text) FROM documents WHERE doc_id % 3 <> 0),
ruled AS (
    SELECT *, CASE WHEN path GLOB 'files/en/**' THEN 'r1'
                   WHEN path GLOB '**/*.pdf' AND owner = 'src8' THEN 'r2'
                   WHEN path GLOB '*[13579].txt' THEN 'r3' ELSE 'r4' END AS rule_id
    FROM owned),
rule_modes(rule_id, rule_mode) AS (
    VALUES ('r1', 'force'), ('r2', 'lazy'), ('r3', 'missing'), ('r4', 'auto')),
known AS (
    SELECT d.doc_id AS file_id, d.text, c.content,
           lang <> 'de' OR doc_id % 3 <> 0 AS has_md5, n_chars > 1000 AS has_sha256
    FROM documents d JOIN content c ON c.file_id = d.doc_id),
eav AS (
    SELECT file_id, concat('file-checksum-', algo) AS meta_key,
           substr(hash, 1, 63) AS meta_value_string, CAST(NULL AS BIGINT) AS meta_value_int
    FROM recorded
    UNION ALL
    SELECT file_id, 'file-checksum-updated_at',
           CASE WHEN pending_mode IS NOT NULL THEN concat('pending:', pending_mode) END, updated_at
    FROM state
    UNION ALL
    SELECT doc_id, 'photos-size', NULL, n_chars FROM documents)
"""


def _groups(index: str, count: str = "count(*)") -> str:
    return (
        f"SELECT algo, hash AS hash_value, {count} AS file_count FROM {index}"
        " GROUP BY algo, hash HAVING count(*) >= 2"
    )


_SHA1 = "(SELECT * FROM idx WHERE algo = 'sha1')"
_TOP = (
    "(SELECT hash FROM idx WHERE algo = '{0}' GROUP BY hash"
    " ORDER BY count(*) DESC, hash LIMIT 1)"
)
_FRESH = "coalesce(s.updated_at >= f.mtime, false)"
_ISO = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'"

_WITH_PATHS = f"""
    , seen AS (
        SELECT i.algo, i.hash AS hash_value, o.fileid, o.path, o.name, o.owner
        FROM {_SHA1} i JOIN owned o ON o.fileid = i.file_id WHERE {{scope}}),
    totals AS (SELECT algo, hash AS hash_value, count(*) AS total_count FROM {_SHA1}
               GROUP BY algo, hash),
    visible AS (SELECT algo, hash_value, count(*) AS file_count FROM seen
                GROUP BY algo, hash_value HAVING count(*) >= 2),
    listed AS (SELECT s.algo, s.hash_value, v.file_count, t.total_count,
                      s.fileid, s.path, s.name, s.owner
               FROM seen s JOIN visible v USING (algo, hash_value)
               JOIN totals t USING (algo, hash_value))
"""
_ALL_PATHS = _WITH_PATHS.format(scope="true")
_USER_PATHS = _WITH_PATHS.format(scope="o.storage_id = 'home::src8'")

_TERM_PARTS = r"""
    , raw AS (
        SELECT CASE WHEN lang = 'en' THEN concat('sha1:', sha1(text))
                    WHEN lang = 'de' THEN upper(md5(text))
                    WHEN lang = 'fr' THEN concat('SHA256: ', sha256(text))
                    ELSE concat('  sha3-256:', sha256(text)) END AS term, lang, text
        FROM documents)
"""

_VERIFIED = """
    , dup AS (SELECT algo, hash AS hash_value, count(*) AS file_count FROM recorded
              WHERE algo = 'sha1' GROUP BY algo, hash HAVING count(*) >= 2),
    members AS (
        SELECT d.algo, d.hash_value, d.file_count, r.file_id, sha1(c.content) AS verified_hash
        FROM dup d JOIN recorded r ON r.algo = d.algo AND r.hash = d.hash_value
        JOIN content c ON c.file_id = r.file_id),
    checked AS (SELECT *, coalesce(verified_hash = hash_value, false) AS verified FROM members),
    groups AS (SELECT algo, hash_value, file_count,
                      count(*) FILTER (WHERE verified) AS match_count,
                      count(*) FILTER (WHERE NOT verified) AS mismatch_count
               FROM checked GROUP BY algo, hash_value, file_count)
"""


def _drained(queue: str) -> str:
    return f"""
    , queue AS ({queue}),
    resolved AS (
        SELECT q.*, r.mtime, k.text, k.content, k.has_md5, k.has_sha256,
               CASE WHEN q.pending_mode = 'new' THEN m.rule_mode ELSE q.pending_mode END AS mode,
               CASE WHEN q.pending_mode = 'new' THEN r.rule_id END AS rule_id
        FROM queue q JOIN ruled r ON r.fileid = q.file_id
        JOIN rule_modes m USING (rule_id) JOIN known k ON k.file_id = q.file_id),
    wanted AS (
        SELECT *, mode IN ('force', 'lazy') AS clears,
               NOT mode IN ('force', 'lazy') AND updated_at >= mtime AS fresh,
               mode <> 'lazy' AND (rule_id IS NULL OR rule_id <> 'r1') AS w_sha1,
               CASE mode WHEN 'auto' THEN has_md5 WHEN 'lazy' THEN false
                    ELSE rule_id IS NULL OR rule_id <> 'r1' END AS w_md5,
               CASE mode WHEN 'auto' THEN has_sha256 WHEN 'lazy' THEN false
                    ELSE rule_id IS NULL OR rule_id <> 'r3' END AS w_sha256,
               CASE WHEN mode IN ('force', 'missing') AND rule_id IS NULL THEN 5 ELSE 0 END AS w_rest
        FROM resolved),
    needs AS (
        SELECT *,
               w_sha1 AND NOT fresh AS n_sha1,
               w_md5 AND NOT (fresh AND has_md5) AS n_md5,
               w_sha256 AND NOT (fresh AND has_sha256) AS n_sha256
        FROM wanted),
    ended AS (
        SELECT *, n_sha1::BIGINT + n_md5::BIGINT + n_sha256::BIGINT + w_rest AS n,
               content IS NOT NULL
               OR n_sha1::BIGINT + n_md5::BIGINT + n_sha256::BIGINT + w_rest = 0 AS success
        FROM needs),
    outcome AS (
        SELECT file_id, pending_mode, mode, success,
               CASE WHEN NOT success THEN updated_at WHEN mode = 'lazy' THEN 0 ELSE {NOW} END
                   AS updated_at,
               CASE WHEN NOT success THEN mode END AS next_pending,
               CASE WHEN success THEN n ELSE 0 END AS computed,
               CASE WHEN success AND n_sha1 THEN sha1(content)
                    WHEN success AND clears THEN NULL ELSE sha1(text) END AS sha1,
               CASE WHEN success AND n_md5 THEN md5(content)
                    WHEN success AND clears OR NOT has_md5 THEN NULL ELSE md5(text) END AS md5,
               CASE WHEN success AND n_sha256 THEN sha256(content)
                    WHEN success AND clears OR NOT has_sha256 THEN NULL ELSE sha256(text) END AS sha256,
               CASE WHEN success THEN w_rest ELSE 0 END AS rest
        FROM ended)
"""


_DRAIN = _drained("SELECT * FROM state WHERE pending_mode IS NOT NULL")
_REBUILD = _drained(
    "SELECT * FROM state WHERE pending_mode IS NOT NULL UNION ALL "
    "SELECT fileid, 0, 'new' FROM files WHERE fileid NOT IN (SELECT file_id FROM state)"
)
_OUTCOME = """
    SELECT file_id, pending_mode, mode, success, updated_at, next_pending,
           CAST(computed AS BIGINT) AS computed,
           CAST((sha1 IS NOT NULL)::BIGINT + (md5 IS NOT NULL)::BIGINT
                + (sha256 IS NOT NULL)::BIGINT + rest AS BIGINT) AS hash_count,
           sha1, md5, sha256
    FROM outcome
"""


def _rehashed(source: str, algos: tuple[str, ...], skip: bool = True) -> str:
    """Result rows of hashing requests over files with recorded and packed hashes."""
    have = {"sha1": "true", "md5": "k.has_md5", "sha256": "k.has_sha256"}
    parts = [
        f"""SELECT f.fileid AS file_id, '{a}' AS algo,
                   {_FRESH if skip else 'false'} AND {have[a]} AS existed,
                   {a}(k.text) AS old_hash, {a}(k.content) AS new_hash
            FROM {source} f JOIN known k ON k.file_id = f.fileid
            LEFT JOIN state s ON s.file_id = f.fileid"""
        for a in algos
    ]
    return f"""
    , made AS ({" UNION ALL ".join(parts)}),
    results AS (
        SELECT file_id, algo, existed OR new_hash IS NOT NULL AS success,
               CASE WHEN existed THEN old_hash ELSE coalesce(new_hash, '') END AS hash,
               existed,
               CASE WHEN NOT existed AND new_hash IS NULL THEN 'Content not readable.' END AS error
        FROM made)
"""


_GENERATED = _rehashed(
    "(SELECT * FROM files WHERE checksum IS NULL AND regexp_replace(path, '^files/', '') GLOB '*.[pt]*')",
    ("sha1", "md5"),
)

_EVENTS = """
    , ev AS (
        SELECT event_id, ts, user_id AS file_id, rule_mode AS mode,
               CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'written'
                               WHEN 'purchase' THEN 'copied' WHEN 'error' THEN 'deleted'
                               ELSE 'metadata' END AS kind
        FROM events JOIN ruled ON fileid = user_id JOIN rule_modes USING (rule_id)),
    clears AS (
        SELECT file_id, min((ts, event_id)) AS first_clear FROM ev
        WHERE (kind = 'written' AND mode IN ('force', 'lazy'))
           OR (kind = 'created' AND mode = 'force') OR kind = 'deleted'
        GROUP BY file_id),
    effects AS (
        SELECT e.file_id, e.ts, e.event_id,
               CASE WHEN kind = 'copied' THEN 'auto'
                    WHEN kind = 'deleted' THEN ''
                    WHEN kind = 'metadata' THEN
                        CASE WHEN c.first_clear IS NULL OR (e.ts, e.event_id) < c.first_clear
                             THEN 'missing' ELSE 'new' END
                    WHEN mode IN ('force', 'lazy') THEN mode
                    WHEN mode = 'auto'
                         AND (c.first_clear IS NULL OR (e.ts, e.event_id) < c.first_clear) THEN 'auto'
               END AS effect
        FROM ev e LEFT JOIN clears c ON c.file_id = e.file_id),
    lasts AS (SELECT file_id, arg_max(effect, (ts, event_id)) AS effect FROM effects
              WHERE effect IS NOT NULL GROUP BY file_id),
    touched AS (SELECT file_id FROM state UNION SELECT file_id FROM ev),
    n AS (SELECT file_id, count(*) AS n FROM recorded GROUP BY file_id)
"""

_SETTINGS = """
    , parsed AS (
        SELECT doc_id, 0 AS priority, concat('a', doc_id) AS id, true AS enabled, 'force' AS mode,
               'sha256,nope' AS algos, concat(source, '/**') AS path, source AS user_scope
        FROM documents WHERE lang = 'en'
        UNION ALL
        SELECT doc_id, 1, 'b', false, 'auto', 'nope', '**', 'all' FROM documents WHERE lang = 'en'
        UNION ALL
        SELECT doc_id, 0, source, true, 'auto', NULL, '**', 'all'
        FROM documents WHERE lang NOT IN ('en', 'de', 'fr'))
"""

# Checksums byte by byte: the CRC takes its table (polynomial 04c11db7, most
# significant bit first) from eight shifts of every byte value.
_CHECKSUMS = """
    , bytes AS (
        SELECT doc_id, octet_length(encode(text)) AS n,
               list_transform(regexp_extract_all(hex(encode(text)), '..'),
                              lambda x: ('0x' || x)::BIGINT) AS v
        FROM documents),
    shifted AS (
        SELECT i, list_reduce(list_prepend((i << 24)::BIGINT, list_transform(range(8), lambda k: -1::BIGINT)),
                   lambda acc, _: CASE WHEN acc & 2147483648 <> 0
                                       THEN xor((acc << 1) & 4294967295, 79764919)
                                       ELSE (acc << 1) & 4294967295 END) AS v
        FROM range(256) t(i)),
    crc_table AS (SELECT list(v ORDER BY i) AS t FROM shifted),
    crc AS (
        SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, v),
                   lambda acc, x: xor((acc << 8) & 4294967295, t[xor(acc >> 24, x) + 1])),
                   4294967295) AS c
        FROM bytes, crc_table),
    adler AS (
        SELECT doc_id, (1 + list_sum(v)) % 65521 AS lo,
               (n + list_sum(list_transform(v, lambda x, i: x * (n - i + 1)))) % 65521 AS hi
        FROM bytes)
"""

_BODIES: dict[str, str] = {
    "duplicate_groups": """
        SELECT algo, hash AS hash_value, count(*) AS file_count,
               min(file_id) AS first_file_id, max(file_id) AS last_file_id
        FROM idx GROUP BY algo, hash HAVING count(*) >= 2""",
    "duplicate_members": f"""
        SELECT g.*, i.file_id FROM ({_groups("idx")}) g
        JOIN idx i ON i.algo = g.algo AND i.hash = g.hash_value""",
    "duplicate_groups_page": f"""
        SELECT *, count(*) OVER () > 35 AS has_more FROM (
            SELECT algo, hash AS hash_value, count(*) AS file_count, min(file_id) AS first_file_id,
                   max(file_id) AS last_file_id, count(*) OVER () AS total_groups
            FROM {_SHA1} GROUP BY algo, hash HAVING count(*) >= 2)
        ORDER BY file_count DESC, algo, hash_value LIMIT 25 OFFSET 10""",
    "duplicate_group_lists": f"""
        SELECT algo, hash AS hash_value, count(*) AS file_count, CAST(0 AS BIGINT) AS part,
               string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id) AS file_ids
        FROM {_SHA1} GROUP BY algo, hash HAVING count(*) >= 2""",
    "duplicates_with_paths": _ALL_PATHS + "SELECT * FROM listed",
    "duplicates_user": _USER_PATHS
    + """
        SELECT s.algo, s.hash_value, v.file_count, min(s.fileid) AS first_file_id,
               max(s.fileid) AS last_file_id, (SELECT count(*) FROM visible) AS total_groups,
               (SELECT count(*) FROM visible) > 500 AS has_more
        FROM seen s JOIN visible v USING (algo, hash_value)
        GROUP BY ALL ORDER BY v.file_count DESC, s.algo, s.hash_value LIMIT 500""",
    "duplicates_user_files": _USER_PATHS + "SELECT * FROM listed",
    "duplicates_json": _ALL_PATHS
    + """
        SELECT algo, hash_value, CAST(0 AS BIGINT) AS part,
               concat('{"algo":"', algo, '","hash_value":"', hash_value, '","file_count":', file_count,
                      ',"files":[', string_agg(concat('{"fileid":', fileid, ',"path":"', path,
                      '","name":"', name, '","owner":"', owner, '"}'), ',' ORDER BY fileid), ']}') AS json
        FROM listed GROUP BY algo, hash_value, file_count""",
    "duplicates_text": _ALL_PATHS
    + """
        SELECT algo, hash_value, CAST(NULL AS BIGINT) AS fileid,
               concat(upper(algo), ' / ', hash_value, ' (', file_count, ' files)') AS line
        FROM visible
        UNION ALL
        SELECT algo, hash_value, fileid, concat('  [', fileid, '] (', owner, ') ', path) FROM listed""",
    "prefix_collisions": """
        , cut AS (
            SELECT algo, hash FROM idx
            UNION ALL
            SELECT 'sha256', concat(substr(sha256(source), 1, 63), substr(sha256(text), 64, 1)) FROM documents)
        SELECT algo, substr(hash, 1, 63) AS hash_prefix, count(DISTINCT hash) AS hashes,
               count(*) AS file_count
        FROM cut
        GROUP BY algo, substr(hash, 1, 63) HAVING count(DISTINCT hash) > 1""",
    "same_hash": """
        , i AS (SELECT * FROM idx),
        probes AS (SELECT algo, hash, count(*) AS probe_count, min(file_id) AS probe
                   FROM i WHERE file_id IN (SELECT file_id FROM state) GROUP BY algo, hash)
        SELECT i.algo, i.hash AS hash_value, i.file_id, p.probe_count
        FROM i JOIN probes p ON p.algo = i.algo AND p.hash = i.hash
        WHERE EXISTS (SELECT 1 FROM i o JOIN state s ON s.file_id = o.file_id
                      WHERE o.algo = i.algo AND o.hash = i.hash AND o.file_id <> i.file_id)""",
    "same_hash_user": """
        , i AS (SELECT * FROM idx)
        SELECT i.algo, i.hash AS hash_value, f.fileid, f.path, f.name
        FROM i JOIN owned f ON f.fileid = i.file_id AND f.storage_id = 'home::src8'
        WHERE EXISTS (SELECT 1 FROM i o JOIN state s ON s.file_id = o.file_id
                      WHERE o.algo = i.algo AND o.hash = i.hash AND o.file_id <> i.file_id)""",
    "same_hash_of": """
        , groups AS (SELECT hash, count(*) AS n, min(file_id) AS first FROM idx WHERE algo = 'sha1' GROUP BY hash),
        largest AS (SELECT first FROM groups WHERE n > 1 ORDER BY n DESC, hash LIMIT 1)
        SELECT i.algo, i.hash AS hash_value, i.file_id
        FROM idx i, largest l
        WHERE i.file_id <> l.first AND (i.algo, i.hash) IN (
            SELECT (algo, hash) FROM idx WHERE file_id = (SELECT first FROM largest))""",
    "same_hash_counts": """
        SELECT i.file_id, i.algo, i.hash AS hash_value, g.n - 1 AS other_files
        FROM idx i JOIN (SELECT algo, hash, count(*) AS n FROM idx GROUP BY algo, hash) g
             ON g.algo = i.algo AND g.hash = i.hash
        WHERE g.n > 1""",
    "lookup_by_hash": f"""
        SELECT o.fileid, i.algo, i.hash, o.path, o.name, count(*) OVER () > 500 AS has_more
        FROM idx i JOIN owned o ON o.fileid = i.file_id
        WHERE i.hash = {_TOP.format("sha1")} ORDER BY o.fileid, i.algo LIMIT 500""",
    "lookup_absent_hash": """
        SELECT o.fileid, i.algo, i.hash, o.path, o.name, false AS has_more
        FROM idx i JOIN owned o ON o.fileid = i.file_id
        WHERE i.hash = sha1('The quick brown fox jumps over the lazy dog.')""",
    "lookup_by_algo_hash": f"""
        SELECT file_id, algo, hash FROM idx WHERE algo = 'md5' AND hash = {_TOP.format("md5")}""",
    "lookup_user_scoped": """
        SELECT o.fileid, i.algo, i.hash, o.path, o.name
        FROM idx i JOIN owned o ON o.fileid = i.file_id
        WHERE i.algo = 'sha1' AND o.storage_id = 'home::src8'""",
    "lookup_long_hash": """
        SELECT doc_id AS file_id, 'sha256' AS algo, sha256(text) AS hash
        FROM documents WHERE n_chars > 1000 AND lang NOT IN ('es', 'fr')""",
    "lookup_batch": """
        SELECT o.fileid, i.algo, i.hash, o.path, o.name
        FROM idx i JOIN owned o ON o.fileid = i.file_id
        WHERE (i.algo, i.hash) IN (SELECT (algo, hash) FROM packed)""",
    "search_terms": """
        SELECT o.fileid, i.algo, i.hash, o.path, o.name
        FROM idx i JOIN owned o ON o.fileid = i.file_id
        WHERE (i.algo = 'sha1' AND i.hash IN (SELECT sha1(text) FROM documents WHERE lang = 'en'))
           OR i.hash IN (SELECT md5(text) FROM documents WHERE lang = 'de')""",
    "search_terms_user": """
        SELECT o.fileid, i.algo, i.hash, o.path, o.name
        FROM idx i JOIN owned o ON o.fileid = i.file_id
        WHERE o.storage_id = 'home::src8'
          AND ((i.algo = 'sha1' AND i.hash IN (SELECT sha1(text) FROM documents WHERE lang = 'en'))
               OR i.hash IN (SELECT md5(text) FROM documents WHERE lang = 'de'))""",
    "parse_terms": _TERM_PARTS
    + """
        SELECT term, CASE lang WHEN 'en' THEN 'sha1' WHEN 'es' THEN 'sha3-256' END AS algo,
               CASE lang WHEN 'en' THEN sha1(text) WHEN 'de' THEN md5(text)
                         WHEN 'es' THEN sha256(text) END AS hash
        FROM raw""",
    "parse_terms_strict": _TERM_PARTS
    + """
        SELECT term, CASE WHEN lang = 'en' THEN 'sha1' END AS algo,
               CASE lang WHEN 'en' THEN sha1(text) WHEN 'de' THEN md5(text) END AS hash
        FROM raw""",
    "scan_like": f"""
        SELECT fileid, path, checksum FROM files WHERE contains(checksum, {_TOP.format("sha1")})""",
    "hashes_by_file": f"""
        SELECT r.file_id AS fileid, r.algo, r.hash, {_ISO.format("s.updated_at")} AS updated_at
        FROM recorded r LEFT JOIN state s ON s.file_id = r.file_id""",
    "hashes_for_user": f"""
        SELECT r.file_id AS fileid, r.algo, r.hash, {_ISO.format("s.updated_at")} AS updated_at
        FROM recorded r JOIN owned o ON o.fileid = r.file_id AND o.storage_id = 'home::src8'
        LEFT JOIN state s ON s.file_id = r.file_id""",
    "hashes_by_path": f"""
        SELECT r.file_id AS fileid, r.algo, r.hash, {_ISO.format("s.updated_at")} AS updated_at,
               o.owner, o.path
        FROM recorded r JOIN owned o ON o.fileid = r.file_id
        JOIN documents d ON o.owner = d.source
             AND o.path = concat('files/', d.lang, '/doc_', d.doc_id, '.pdf')
        LEFT JOIN state s ON s.file_id = r.file_id""",
    "hash_count_per_file": """
        SELECT doc_id AS file_id,
               CAST(1 + (lang <> 'de')::BIGINT + (n_chars > 1000)::BIGINT AS BIGINT) AS hash_count
        FROM documents""",
    "resolve_paths": "SELECT fileid, path, name, storage_id, owner FROM owned",
    "owner_from_storage": "SELECT id, owner FROM owners",
    "users_in_scope": """
        SELECT 'all' AS scope, owner AS "user" FROM (SELECT DISTINCT owner FROM owners)
        UNION ALL SELECT 'src8', owner FROM (SELECT DISTINCT owner FROM owners WHERE owner = 'src8')""",
    "relative_paths": """
        SELECT fileid, regexp_replace(path, '^files/en/', '') AS below_en, path AS outside,
               '' AS itself
        FROM files""",
    "scan_inventory": "SELECT fileid, storage, path, name, size, mtime FROM files",
    "walk_stats": """
        SELECT owner, count(*) AS files,
               count(*) FILTER (WHERE NOT hit) AS glob_skipped,
               count(*) FILTER (WHERE hit AND checksum IS NOT NULL) AS already_hashed,
               count(*) FILTER (WHERE hit AND checksum IS NULL) AS collected
        FROM (SELECT *, regexp_replace(path, '^files/', '') GLOB '*.[mt]*' AS hit FROM owned)
        GROUP BY owner""",
    "parse_checksums": "SELECT file_id AS fileid, algo, hash FROM packed",
    "parse_checksums_filtered": """
        SELECT fileid, CASE WHEN checksum IS NOT NULL THEN 'later' END AS md5,
               CAST(CASE WHEN checksum IS NULL THEN 0 ELSE 2 END AS BIGINT) AS algos,
               CAST(CASE WHEN checksum IS NULL THEN 0 ELSE 2 END AS BIGINT) AS malformed
        FROM files""",
    "pack_checksums": """
        SELECT doc_id, concat('SHA1:', sha1(text), ' MD5:', md5(text), ' SHA256:', sha256(text),
                              ' SHA3-256:', sha256(text)) AS packed
        FROM documents""",
    "pack_keep_additional": """
        SELECT f.fileid,
               concat('SHA1:', sha1(f.path), ' SHA256:', sha256(f.path),
                      CASE WHEN f.checksum IS NOT NULL THEN concat(' MD5:', md5(d.text)) ELSE '' END) AS kept,
               concat('SHA1:', sha1(f.path), ' SHA256:', sha256(f.path)) AS replaced
        FROM files f JOIN documents d ON d.doc_id = f.fileid""",
    "packed_mirror": """
        SELECT f.fileid,
               concat('SHA1:', sha1(d.text),
                      CASE WHEN d.lang <> 'de' THEN concat(' MD5:', md5(d.text)) ELSE '' END,
                      CASE WHEN d.n_chars > 1000 THEN concat(' SHA256:', sha256(d.text)) ELSE '' END,
                      CASE WHEN d.lang = 'de' AND f.checksum IS NOT NULL
                           THEN concat(' MD5:', md5(d.text)) ELSE '' END) AS checksum
        FROM files f JOIN documents d ON d.doc_id = f.fileid""",
    "copy_checksums": """
        SELECT e.user_id AS file_id, arg_max(s.checksum, (e.ts, e.event_id)) AS checksum
        FROM events e JOIN files s ON s.fileid = e.user_id + 1 JOIN files t ON t.fileid = e.user_id
        WHERE e.event_type = 'purchase' AND s.checksum IS NOT NULL GROUP BY e.user_id""",
    # the copies one after another, with a map from files to the file whose checksum they have
    "copy_chains": """
        , had AS (SELECT map_from_entries(list((fileid, fileid))) AS m FROM files WHERE checksum IS NOT NULL),
        step AS (
            SELECT row_number() OVER (ORDER BY ts, event_id) AS n, user_id AS target, user_id + 1 AS source
            FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL),
        walk(n, m, hit) AS (
            SELECT 0::BIGINT, m, NULL::BIGINT FROM had
            UNION ALL
            SELECT s.n,
                   CASE WHEN map_contains(w.m, s.source)
                        THEN map_concat(w.m, MAP {s.target: w.m[s.source]}) ELSE w.m END,
                   CASE WHEN map_contains(w.m, s.source) THEN s.target END
            FROM walk w JOIN step s ON s.n = w.n + 1),
        final AS (SELECT unnest(map_entries(arg_max(m, n))) AS e FROM walk)
        SELECT f.e.key AS file_id, r.checksum
        FROM final f JOIN files r ON r.fileid = f.e.value JOIN files t ON t.fileid = f.e.key
        WHERE f.e.key IN (SELECT hit FROM walk WHERE hit IS NOT NULL)""",
    "sync_legacy": """
        SELECT p.* FROM packed p
        WHERE (file_id, algo) NOT IN (SELECT (file_id, algo) FROM recorded)""",
    "missing_hashes": """
        SELECT fileid AS file_id,
               CASE WHEN checksum IS NULL THEN 'sha1,sha256,md5' ELSE 'sha256' END AS missing
        FROM files""",
    "algo_normalize": """
        SELECT doc_id,
               CASE lang WHEN 'en' THEN 'sha1,md5,adler32,crc32,sha256,sha512,sha3-256,sha3-512'
                         WHEN 'de' THEN concat('sha1,md5,', source)
                         ELSE concat(source, ',md5') END AS algos,
               CASE lang WHEN 'en' THEN 'sha1,md5,adler32,crc32,sha256,sha512,sha3-256,sha3-512'
                         WHEN 'de' THEN 'sha1,md5' ELSE 'md5' END AS supported
        FROM documents""",
    "pending_modes": "SELECT file_id, pending_mode AS mode FROM state",
    "json_import": """
        SELECT i.file_id, i.algo, i.hash FROM idx i JOIN documents d ON d.doc_id = i.file_id
        WHERE d.lang NOT IN ('es', 'fr')""",
    "json_authoritative": """
        SELECT doc_id AS file_id, 'md5' AS algo,
               CASE WHEN lang NOT IN ('es', 'fr') THEN md5(text) END AS hash
        FROM documents""",
    "json_export": """
        , parts AS (
            SELECT s.file_id, s.updated_at, sha1(d.text) AS h1,
                   CASE WHEN d.n_chars > 1000 THEN sha256(d.text) END AS h2
            FROM state s JOIN documents d ON d.doc_id = s.file_id)
        SELECT file_id, concat(
            '{"file-checksum-sha1":{"value":"', h1,
            '","type":"string","etag":"","indexed":true,"editPermission":0},',
            CASE WHEN h2 IS NOT NULL THEN concat('"file-checksum-sha256":{"value":"', h2,
                '","type":"string","etag":"","indexed":true,"editPermission":0},') ELSE '' END,
            '"file-checksum-updated_at":{"value":"', updated_at,
            '","type":"int","etag":"","indexed":true,"editPermission":0}}') AS json
        FROM parts""",
    "json_quarantine": """
        SELECT doc_id AS file_id, concat('{"file-checksum-sha1":"', sha1(text)) AS json
        FROM documents WHERE lang = 'es'""",
    "packed_quarantine": """
        SELECT fileid AS file_id, concat(checksum, ' x y:z:1 FOO:1') AS packed,
               CAST(3 AS BIGINT) AS bad_pairs
        FROM files WHERE ends_with(path, '.md') AND checksum IS NOT NULL""",
    "eav_import": """
        SELECT r.file_id, r.algo, r.hash FROM recorded r JOIN documents d ON d.doc_id = r.file_id
        WHERE r.algo <> 'sha256' OR d.lang NOT IN ('es', 'fr')""",
    "eav_quarantine": """
        SELECT r.file_id, 'file-checksum-sha256' AS meta_key, substr(r.hash, 1, 63) AS meta_value_string
        FROM recorded r JOIN documents d ON d.doc_id = r.file_id
        WHERE r.algo = 'sha256' AND d.lang IN ('es', 'fr')""",
    "packed_dropped": "SELECT file_id, algo, hash FROM idx WHERE algo = 'sha256'",
    "eav_state_import": "SELECT file_id, updated_at, pending_mode FROM state",
    "eav_export": "SELECT * FROM eav WHERE meta_key <> 'photos-size'",
    "packed_export": """
        SELECT doc_id AS file_id,
               concat('SHA1:', sha1(text),
                      CASE WHEN lang <> 'de' THEN concat(' MD5:', md5(text)) ELSE '' END,
                      CASE WHEN n_chars > 1000 THEN concat(' SHA256:', sha256(text)) ELSE '' END) AS checksum
        FROM documents""",
    "status_json": """
        SELECT concat('{"filecache_rows":', (SELECT count(*) FROM files),
                      ',"hash_rows":', (SELECT count(*) FROM recorded),
                      ',"metadata_rows":', count(*), ',"pending_total":', count(pending_mode),
                      ',"pending_by_mode":{"new":', count(*) FILTER (WHERE pending_mode = 'new'),
                      ',"missing":', count(*) FILTER (WHERE pending_mode = 'missing'),
                      ',"auto":', count(*) FILTER (WHERE pending_mode = 'auto'),
                      ',"force":', count(*) FILTER (WHERE pending_mode = 'force'),
                      ',"lazy":', count(*) FILTER (WHERE pending_mode = 'lazy'), ',"other":0}}') AS json
        FROM state""",
    "glob_filter": """
        SELECT page_id, url GLOB 'http*://*.example.[cno]*/*' AS any_site,
               url GLOB 'https://*' AS secure, url GLOB '*/[!ef]?/*[0-9]' AS plain_de,
               url GLOB '*[?]page=?&*' AS paged, url GLOB '*.html' AS html
        FROM pages""",
    "glob_search": "SELECT fileid, path FROM files WHERE path GLOB 'files/*/doc_*[02468].pdf'",
    "glob_search_limit": """
        SELECT fileid, path FROM files WHERE path GLOB 'files/[!e]*/doc_*.??'
        ORDER BY fileid LIMIT 50""",
    "rule_prefix": """
        SELECT page_id, concat('/', rtrim(regexp_extract(concat(url, '/*.txt'), '^[^*?{\\[]*'), '/')) AS folder
        FROM pages""",
    "rules_import": _SETTINGS + "SELECT * FROM parsed",
    "rules_validate": _SETTINGS
    + """
        SELECT doc_id, priority,
               CASE algos WHEN 'sha256,nope' THEN 'sha256' WHEN 'nope' THEN '' ELSE 'sha1' END AS algos,
               algos IS NULL OR algos <> 'nope' AS valid
        FROM parsed""",
    "string_list_import": """
        SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE concat(source, ',', lang) END AS items
        FROM documents""",
    "first_matching_rule": """
        SELECT fileid, rule_id, rule_mode FROM ruled JOIN rule_modes USING (rule_id)""",
    "evaluate_rules": f"""
        SELECT f.fileid AS file_id, f.rule_id, m.rule_mode AS mode, NOT {_FRESH} AS stale
        FROM ruled f JOIN rule_modes m USING (rule_id) LEFT JOIN state s ON s.file_id = f.fileid""",
    "evaluate_rules_totals": f"""
        SELECT f.rule_id, count(*) AS matched, count(*) FILTER (WHERE NOT {_FRESH}) AS marked
        FROM ruled f LEFT JOIN state s ON s.file_id = f.fileid GROUP BY f.rule_id""",
    "evaluate_rules_capped": f"""
        SELECT f.fileid AS file_id, f.rule_id, m.rule_mode AS mode
        FROM ruled f JOIN rule_modes m USING (rule_id) LEFT JOIN state s ON s.file_id = f.fileid
        WHERE NOT {_FRESH}
        QUALIFY row_number() OVER (PARTITION BY f.rule_id ORDER BY f.fileid) <= 100""",
    "process_rule": f"""
        SELECT f.fileid AS file_id, f.rule_id, m.rule_mode AS mode, NOT {_FRESH} AS stale
        FROM ruled f JOIN rule_modes m USING (rule_id) LEFT JOIN state s ON s.file_id = f.fileid
        WHERE f.rule_id = 'r3'""",
    "sql_functions": """
        SELECT doc_id, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS unknown,
               lang IN ('en', 'es') AS matches, md5(text) AS parsed,
               concat('SHA1:', sha1(text), ' MD5:', md5(text)) AS packed,
               CAST(NULL AS VARCHAR) AS no_term, sha1(text) AS term
        FROM documents""",
    "stale_files": f"""
        SELECT f.fileid AS file_id, f.mtime, s.updated_at
        FROM files f LEFT JOIN state s ON s.file_id = f.fileid WHERE NOT {_FRESH}""",
    "seed_pending": """
        SELECT fileid AS file_id, CAST(0 AS BIGINT) AS updated_at, 'new' AS pending_mode
        FROM files WHERE fileid NOT IN (SELECT file_id FROM state)""",
    "mark_pending": """
        SELECT s.file_id, s.updated_at,
               CASE WHEN f.path GLOB 'files/en/**' THEN 'auto' ELSE s.pending_mode END AS pending_mode
        FROM state s JOIN files f ON f.fileid = s.file_id""",
    "clear_hashes": """
        SELECT * FROM recorded WHERE file_id NOT IN (
            SELECT file_id FROM state WHERE pending_mode = 'force')""",
    "clear_state": """
        SELECT s.file_id, CASE WHEN path GLOB '*.md' THEN 0 ELSE s.updated_at END AS updated_at,
               CASE WHEN NOT path GLOB '*.md' THEN s.pending_mode END AS pending_mode
        FROM state s JOIN files f ON f.fileid = s.file_id""",
    "pending_batch": """
        SELECT * FROM state WHERE pending_mode IS NOT NULL ORDER BY file_id LIMIT 50""",
    "pending_stats": """
        SELECT pending_mode, count(*) AS n FROM state WHERE pending_mode IS NOT NULL
        GROUP BY pending_mode""",
    "needed_hashes": f"""
        , algos(algo) AS (VALUES ('sha1'), ('md5'), ('adler32'), ('crc32'), ('sha256'), ('sha512'),
                                 ('sha3-256'), ('sha3-512')),
        have AS (SELECT file_id, algo FROM recorded UNION SELECT file_id, algo FROM packed)
        SELECT f.fileid AS file_id, a.algo
        FROM files f CROSS JOIN algos a LEFT JOIN state s ON s.file_id = f.fileid
        LEFT JOIN have h ON h.file_id = f.fileid AND h.algo = a.algo
        WHERE h.file_id IS NULL OR NOT {_FRESH}""",
    "recalc_existing": f"""
        , have AS (SELECT file_id, algo, hash FROM recorded WHERE algo <> 'sha1'),
        wanted AS (SELECT file_id, algo FROM have UNION ALL
                   SELECT fileid, 'sha1' FROM files WHERE fileid NOT IN (SELECT file_id FROM have)),
        made AS (
            SELECT w.file_id, w.algo,
                   {_FRESH} AND (w.algo <> 'sha1' OR f.checksum IS NOT NULL) AS existed,
                   CASE w.algo WHEN 'sha1' THEN sha1(d.text) WHEN 'md5' THEN md5(d.text)
                               ELSE sha256(d.text) END AS old_hash,
                   CASE w.algo WHEN 'sha1' THEN sha1(c.content) WHEN 'md5' THEN md5(c.content)
                               ELSE sha256(c.content) END AS new_hash
            FROM wanted w JOIN files f ON f.fileid = w.file_id JOIN documents d ON d.doc_id = w.file_id
            JOIN content c ON c.file_id = w.file_id LEFT JOIN state s ON s.file_id = w.file_id)
        SELECT file_id, algo, existed OR new_hash IS NOT NULL AS success,
               CASE WHEN existed THEN old_hash ELSE coalesce(new_hash, '') END AS hash, existed,
               CASE WHEN NOT existed AND new_hash IS NULL THEN 'Content not readable.' END AS error
        FROM made""",
    "generate_missing": _GENERATED + "SELECT * FROM results",
    "generate_totals": _GENERATED
    + """
        SELECT count(*) FILTER (WHERE hashed) AS processed, count(*) FILTER (WHERE NOT hashed) AS skipped
        FROM (SELECT file_id, bool_or(success AND NOT existed) AS hashed FROM results GROUP BY file_id)""",
    "generate_budget": """
        SELECT fileid, owner FROM owned WHERE regexp_replace(path, '^files/', '') GLOB '*.[pt]*'
        ORDER BY owner, fileid LIMIT 100""",
    "generate_mark": """
        SELECT fileid AS file_id, 'auto' AS mode FROM owned
        WHERE owner = 'src8' AND path GLOB '*.pdf'""",
    "rehash": _rehashed("files", ("sha1", "md5", "sha256")) + "SELECT * FROM results",
    "recalc_user": _rehashed("files", ("sha1", "sha256"))
    + """
        SELECT file_id, algo, seen AND success AS success, CASE WHEN seen THEN hash ELSE '' END AS hash,
               seen AND existed AS existed, CASE WHEN seen THEN error ELSE 'File not found.' END AS error
        FROM (SELECT *, file_id IN (SELECT fileid FROM owned WHERE storage_id = 'home::src8') AS seen FROM results)""",
    "verified_report": _ALL_PATHS
    + """
        , checked AS (
            SELECT l.*, sha1(c.content) AS made, coalesce(sha1(c.content) = hash_value, false) AS ok
            FROM listed l JOIN content c ON c.file_id = l.fileid)
        SELECT algo, hash_value, CAST(0 AS BIGINT) AS part,
               concat('{"algo":"', algo, '","hash_value":"', hash_value, '","file_count":', file_count,
                      ',"match_count":', count(*) FILTER (WHERE ok),
                      ',"mismatch_count":', count(*) FILTER (WHERE NOT ok),
                      ',"files":[', string_agg(concat('{"fileid":', fileid, ',"path":"', path,
                      '","name":"', name, '","owner":"', owner, '","verified":',
                      CASE WHEN ok THEN 'true' ELSE 'false' END,
                      CASE WHEN made IS NULL THEN ',"verify_error":"Content not readable."'
                           ELSE concat(',"verified_hash":"', made, '"') END, '}'), ',' ORDER BY fileid), ']}') AS json
        FROM checked GROUP BY algo, hash_value, file_count""",
    "drain_pending": _DRAIN + _OUTCOME,
    "drain_totals": _DRAIN
    + """
        SELECT pending_mode, count(*) FILTER (WHERE success) AS processed,
               count(*) FILTER (WHERE NOT success) AS failed
        FROM outcome GROUP BY pending_mode""",
    "rebuild": _REBUILD + _OUTCOME,
    "glob_search_page": """
        , hits AS (SELECT fileid, path, row_number() OVER (ORDER BY fileid) AS n, count(*) OVER () AS total
                   FROM files WHERE path GLOB '*[02468].[pm]*')
        SELECT fileid, path, total > 120 AS has_more FROM hits WHERE n > 80 AND n <= 120""",
    "drain_twice": _DRAIN
    + """
        SELECT file_id, mode AS pending_mode, mode, false AS success, updated_at, mode AS next_pending,
               0::BIGINT AS computed,
               CAST((sha1 IS NOT NULL)::BIGINT + (md5 IS NOT NULL)::BIGINT
                    + (sha256 IS NOT NULL)::BIGINT + rest AS BIGINT) AS hash_count,
               sha1, md5, sha256
        FROM outcome WHERE NOT success""",
    "groups_after_drain": _DRAIN
    + """
        , after AS (
            SELECT * FROM recorded WHERE file_id NOT IN (SELECT file_id FROM outcome)
            UNION ALL SELECT file_id, 'sha1', sha1 FROM outcome WHERE sha1 IS NOT NULL
            UNION ALL SELECT file_id, 'md5', md5 FROM outcome WHERE md5 IS NOT NULL
            UNION ALL SELECT file_id, 'sha256', sha256 FROM outcome WHERE sha256 IS NOT NULL)
        SELECT algo, hash AS hash_value, count(*) AS file_count
        FROM after GROUP BY algo, hash HAVING count(*) >= 2""",
    "kept_groups_page": f"""
        SELECT * FROM ({_groups("recorded", "min(file_id) AS first_file_id, max(file_id) AS last_file_id, count(*)")})
        ORDER BY file_count DESC, algo, hash_value LIMIT 25 OFFSET 10""",
    "verify_duplicates": _VERIFIED + "SELECT * FROM groups",
    "verify_members": _VERIFIED
    + """
        SELECT algo, hash_value, file_count, file_id, verified_hash, verified,
               CASE WHEN verified_hash IS NULL THEN 'Content not readable.' END AS verify_error
        FROM checked""",
    "verified_only": _VERIFIED + "SELECT * FROM groups WHERE mismatch_count = 0",
    "matching_only": _VERIFIED
    + f"""
        SELECT * FROM groups WHERE mismatch_count = 0
        UNION ALL
        SELECT algo, hash_value, file_count, NULL, NULL
        FROM ({_groups("(SELECT * FROM recorded WHERE algo = 'md5')")})""",
    "event_fold": _EVENTS
    + """
        SELECT t.file_id,
               CASE WHEN c.file_id IS NOT NULL THEN 0 ELSE coalesce(s.updated_at, 0) END AS updated_at,
               CASE WHEN l.effect IS NULL THEN s.pending_mode ELSE nullif(l.effect, '') END AS pending_mode,
               CASE WHEN c.file_id IS NOT NULL THEN 0 ELSE coalesce(n.n, 0) END AS hash_count,
               c.file_id IS NOT NULL AS cleared
        FROM touched t LEFT JOIN state s ON s.file_id = t.file_id
        LEFT JOIN clears c ON c.file_id = t.file_id LEFT JOIN lasts l ON l.file_id = t.file_id
        LEFT JOIN n ON n.file_id = t.file_id""",
    "digest_sha256": "SELECT * FROM idx WHERE algo = 'sha256'",
    "digest_native": "SELECT * FROM idx",
    "digest_all": _CHECKSUMS
    + """
        , exact AS (
            SELECT file_id, algo, hash FROM idx
            UNION ALL
            SELECT doc_id, 'adler32', printf('%08x', (hi * 65536 + lo)::BIGINT) FROM adler
            UNION ALL
            SELECT doc_id, 'crc32', printf('%02x%02x%02x%02x', c & 255, (c >> 8) & 255, (c >> 16) & 255, c >> 24)
            FROM crc)
        SELECT file_id, algo, hash, length(hash) AS digits,
               min(file_id) OVER (PARTITION BY algo, hash) AS first_file_id
        FROM exact
        UNION ALL
        SELECT doc_id, algo, NULL, digits, min(doc_id) OVER (PARTITION BY algo, text)
        FROM documents CROSS JOIN (VALUES ('sha512', 128::BIGINT), ('sha3-256', 64), ('sha3-512', 128)) a(algo, digits)""",
    "digest_checksums": _CHECKSUMS
    + """
        SELECT doc_id AS file_id, 'adler32' AS algo, printf('%08x', (hi * 65536 + lo)::BIGINT) AS hash
        FROM adler
        UNION ALL
        SELECT doc_id, 'crc32',
               printf('%02x%02x%02x%02x', c & 255, (c >> 8) & 255, (c >> 16) & 255, c >> 24)
        FROM crc""",
    "digest_groups": """
        , g AS (SELECT count(*) AS file_count, min(doc_id) AS first_file_id, max(doc_id) AS last_file_id
                FROM documents GROUP BY text HAVING count(*) >= 2)
        SELECT a.algo, g.* FROM g CROSS JOIN (VALUES ('sha512'), ('sha3-256'), ('sha3-512')) a(algo)""",
    "digest_invalid_algo": """
        SELECT file_id, 'whirlpool' AS algo, false AS success, '' AS hash, false AS existed,
               'Unsupported algorithm: whirlpool' AS error
        FROM content
        UNION ALL
        SELECT file_id, 'sha256', content IS NOT NULL, coalesce(sha256(content), ''), false,
               CASE WHEN content IS NULL THEN 'Content not readable.' END
        FROM content""",
}

ORACLE: dict[str, str] = {name: VIEWS + body for name, body in _BODIES.items()}
ORACLE["copy_chains"] = ORACLE["copy_chains"].replace("WITH files", "WITH RECURSIVE files", 1)
