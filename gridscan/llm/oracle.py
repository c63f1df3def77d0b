"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from gridscan.llm import queries as q
from gridscan.llm.url_filter import LOWER, UPPER


def _chat_format() -> str:
    def escaped(x: str) -> str:
        return f"replace(replace(replace({x}, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>')"

    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT {q.PROBE_ID}, 0, 'user', '{q.PROBE}'
        UNION ALL SELECT {q.PROBE_ID}, 1, '{q.LEARNED}', '{q.PROBE}'
    ), grouped AS (
        SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
            coalesce(string_agg(CASE WHEN role = '{q.LEARNED}' THEN text END, '' ORDER BY turn NULLS FIRST, text), '') AS learned,
            sum(length('### ') + length(replace({escaped("role")}, ':' || chr(10), ':\\' || chr(10))) + 2
                + length({escaped("text")}) + length('</turn>') + 1) AS formatted_chars
        FROM turns GROUP BY conv_id
    )
    SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256,
        CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
        CAST(formatted_chars AS BIGINT) AS formatted_chars
    FROM grouped"""


def _url_filter() -> str:
    def hits(terms: tuple[str, ...]) -> str:
        tests = [f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms]
        return " + ".join(tests) or "0"

    fits = " UNION ALL ".join(
        f"SELECT page_id, '{host}{path}' AS rule, '{verdict}' AS verdict FROM parts "
        f"WHERE (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        for host, path, verdict in q.URL_RULES
    )
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
    WITH parts AS (
        SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
            translate(regexp_extract(coalesce(url, ''), '{pattern}', 1), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(coalesce(url, ''), '{pattern}', 2) AS path
        FROM pages
    ), fits AS ({fits}),
    best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM fits GROUP BY page_id),
    counts AS (SELECT *, {hits(q.URLS.strict)} AS n_strict, {hits(q.URLS.soft)} AS n_soft FROM parts)
    SELECT page_id, host, path, rule, CAST(n_strict AS INTEGER) AS n_strict, CAST(n_soft AS INTEGER) AS n_soft,
        coalesce(verdict, CASE WHEN n_strict >= 1 OR n_soft >= {q.URLS.soft_limit} THEN 'block' ELSE 'allow' END) AS verdict
    FROM counts LEFT JOIN best USING (page_id)"""


def _source_mix() -> str:
    mix = q.MIX
    levels = ["domain", "lang", "source"]
    digit = "substr(md5(coalesce(source, '')), 1, 1)"
    parts = [
        f"""
        docs AS MATERIALIZED (
            SELECT doc_id, lang, source,
                CASE WHEN {digit} < '5' THEN 'books' WHEN {digit} < 'a' THEN 'web' ELSE 'notes' END AS domain,
                CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
            FROM documents
        ), leaves AS (
            SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens,
                CAST(sum(n_tokens) AS BIGINT) * {mix.max_epochs} AS capacity
            FROM docs GROUP BY ALL
        ), given0 AS (
            SELECT 0 AS root, CAST(floor(coalesce(sum(tokens), 0) * CAST({mix.budget_share} AS DOUBLE)) AS BIGINT) AS given
            FROM leaves
        )"""
    ]
    parent = ["root"]
    for depth in range(1, 4):
        path = levels[:depth]
        cases = " ".join(
            "WHEN " + " AND ".join(f"n.{c} = '{v}'" for c, v in zip(path, key)) + f" THEN {w}"
            for key, w in mix.weights.items()
            if len(key) == depth
        )
        weight = f"CAST(CASE {cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"
        of = ", ".join(parent)
        on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM g.{c}" for c in parent)
        tokens = "tokens, " if depth == 3 else ""
        source = f"(SELECT {', '.join(path)}, {tokens}sum(capacity) AS capacity, 0 AS root FROM leaves GROUP BY ALL)"
        parts.append(f"""
        children{depth} AS (
            SELECT n.*, g.given, {weight} AS weight FROM {source} n JOIN given{depth - 1} g ON {on}
        ), ranked{depth} AS (
            SELECT *, row_number() OVER r AS place,
                coalesce(sum(capacity) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                sum(weight) OVER (PARTITION BY {of})
                - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
            FROM children{depth} WHERE weight > 0
            WINDOW r AS (PARTITION BY {of} ORDER BY CAST(capacity AS DOUBLE) / weight NULLS FIRST, capacity, {path[-1]} NULLS FIRST)
        ), opened{depth} AS (
            SELECT *, greatest(given - filled, 0) AS rest_here,
                min(CASE WHEN capacity * weight_left > weight * greatest(given - filled, 0) THEN place END)
                    OVER (PARTITION BY {of}) AS first_open
            FROM ranked{depth}
        ), shared{depth} AS (
            SELECT *, CAST(CASE WHEN first_open IS NULL OR place < first_open THEN capacity
                ELSE (weight * max(CASE WHEN place = first_open THEN rest_here END) OVER (PARTITION BY {of}))
                    // max(CASE WHEN place = first_open THEN weight_left END) OVER (PARTITION BY {of}) END AS BIGINT) AS share
            FROM opened{depth}
        ), given{depth} AS (SELECT {', '.join(path)}, share AS given FROM shared{depth})""")
        parent = path
    return f"""
    WITH {','.join(parts)},
    plan AS (
        SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS full_epochs,
            CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest
        FROM shared3
    ), placed AS (
        SELECT d.*, p.full_epochs, p.rest,
            md5('{mix.seed}:' || p.full_epochs || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS key
        FROM docs d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang
            AND d.source IS NOT DISTINCT FROM p.source
    ), totals AS (
        SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, CAST(doc_id AS VARCHAR)) AS total
        FROM placed
    ), cuts AS (
        SELECT *, max(CASE WHEN total <= rest AND rest > 0 THEN key END) OVER (PARTITION BY domain, lang, source) AS cut
        FROM totals
    )
    SELECT doc_id, domain, lang, source, n_tokens, CAST(e.epoch AS BIGINT) AS epoch
    FROM cuts JOIN (SELECT unnest(range(0, {mix.max_epochs + 1})) AS epoch) e
        ON e.epoch < full_epochs OR (e.epoch = full_epochs AND key <= cut)"""


def _lexical_search() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def terms(table: str) -> str:
        found = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{term}')"
        return f"(SELECT *, unnest({found}) AS term FROM (SELECT *, row_number() OVER () AS row FROM {table}))"

    return f"""
    WITH words AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM {terms('documents')} GROUP BY ALL),
    asked AS MATERIALIZED (SELECT row, item_id, term, count(*) AS times FROM {terms('benchmark')} GROUP BY ALL),
    sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM words GROUP BY row),
    corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
    measures AS (SELECT row, 25 + (75 * n * docs) // total AS m FROM sizes, corpus),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM words GROUP BY term), corpus
    ), scores AS (
        SELECT a.row AS item, any_value(a.item_id) AS item_id, d.row AS doc, any_value(d.doc_id) AS doc_id,
            CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
        FROM asked a JOIN weights USING (term) JOIN words d USING (term) JOIN measures ON measures.row = d.row
        GROUP BY a.row, d.row
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scores WHERE score > 0
    ) WHERE rank <= 10"""


def _merkle_manifest() -> str:
    # Fixed value: the polynomial of CRC32. A byte is taken in, then eight bits are shifted out.
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}::BIGINT[]), lambda c, x: "
        "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c // 2, 3988292384 * (c % 2)) END), 4294967295)"
    )

    def field(value: str) -> str:
        text = f"CAST({value} AS VARCHAR)"
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, leaves: str) -> str:
        """Nodes of all levels; ``total`` is the number of nodes of the level."""
        return f"""
    {name} AS (
        SELECT 0 AS level, part, place, total, hash FROM {leaves}
        UNION ALL
        SELECT level + 1, part, place // 3, any_value((total + 2) // 3), sha256(string_agg(hash, '' ORDER BY place))
        FROM {name} WHERE total > 1 GROUP BY level, part, place // 3
    )"""

    def steps_of(name: str, leaves: str, key: str, base: int) -> str:
        """The siblings of each leaf's ancestors, level by level."""
        own = "(l.place // CAST(3 ** n.level AS BIGINT))"
        return f"""
        SELECT {key}, {base} + n.level AS level,
            coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place < {own}), '') AS before,
            coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place > {own}), '') AS after
        FROM {leaves} l JOIN {name} n ON l.part IS NOT DISTINCT FROM n.part AND n.total > 1
            AND n.place // 3 = {own} // 3
        GROUP BY {key}, n.level"""

    return f"""
    WITH RECURSIVE digests AS MATERIALIZED (
        SELECT row_number() OVER () AS row, doc_id, source AS part, {leaf("text")} AS hash,
            CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS found
        FROM documents
    ), leaves AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, hash, row) - 1 AS place,
            count(*) OVER (PARTITION BY part) AS total
        FROM digests
    ), {tree("nodes", "leaves")},
    subroots AS MATERIALIZED (
        SELECT 0 AS part, part AS source, hash,
            row_number() OVER (ORDER BY part NULLS FIRST) - 1 AS place, count(*) OVER () AS total
        FROM nodes WHERE total = 1
    ), {tree("tops", "subroots")},
    top_steps AS MATERIALIZED ({steps_of("tops", "subroots", "l.source", 1000)}),
    steps AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY row ORDER BY level) AS step FROM (
            {steps_of("nodes", "leaves", "l.row", 0)}
            UNION ALL SELECT row, level, before, after FROM leaves JOIN top_steps ON part IS NOT DISTINCT FROM source
        )
    ), folds AS (
        SELECT row, CAST(1 AS BIGINT) AS step, found AS hash FROM leaves
        UNION ALL
        SELECT row, f.step + 1, sha256(before || hash || after) FROM folds f JOIN steps USING (row, step)
    ), ends AS (SELECT row, arg_max(hash, step) AS folded_root FROM folds GROUP BY row),
    proofs AS (SELECT row, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY row)
    SELECT doc_id, l.hash AS leaf, s.hash AS subroot, t.hash AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
        folded_root, folded_root = t.hash AS verified
    FROM leaves l JOIN subroots s ON l.part IS NOT DISTINCT FROM s.source JOIN (SELECT hash FROM tops WHERE total = 1) t ON true
    JOIN ends USING (row) LEFT JOIN proofs USING (row)"""


def llm_sql() -> dict[str, str]:
    return {
        "op1_chat_format": _chat_format(),
        "op2_url_filter": _url_filter(),
        "op6_source_mix": _source_mix(),
        "op12_lexical_search": _lexical_search(),
        "op13_merkle_manifest": _merkle_manifest(),
    }
