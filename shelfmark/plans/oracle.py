"""For each registered query, the same result as plain SQL over the test tables.

The SQL is written for checking, not for speed: nested loops, correlated
subqueries and windows where the library uses something else.
"""

from __future__ import annotations

# The catalog views; each may use the test tables and the views named with it.
_VIEWS = {
    "anatomical_area": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
    "modality": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "ml_task": """
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id, o_orderpriority AS name
        FROM orders""",
    "tag": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "dataset": """
        SELECT p_partkey AS id, p_name AS title,
               CASE WHEN p_partkey % 7 <> 0 THEN p_type || ' ' || p_brand END AS description,
               'http://example.org/ds/' || p_partkey AS external_path,
               CAST(NULL AS VARCHAR) AS local_path,
               CASE WHEN p_partkey % 5 <> 0 THEN CAST(coalesce(n, 0) AS INTEGER) END AS record_count,
               p_size AS size,
               CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 5 END AS anatomical_area_id,
               created_at, updated_at
        FROM part LEFT JOIN (
            SELECT l_partkey, count(*) AS n, min(l_shipdate) AS created_at, max(l_shipdate) AS updated_at
            FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "dataset_modality": """
        SELECT DISTINCT l_partkey AS dataset_id, CAST(s_nationkey AS BIGINT) AS modality_id
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
    "dataset_ml_task": """
        SELECT DISTINCT l_partkey AS dataset_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS ml_task_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "dataset_tag": """
        SELECT DISTINCT l_partkey AS dataset_id, l_suppkey AS tag_id FROM lineitem""",
    "roles": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "users": """
        SELECT c_custkey AS id, c_name AS username, CAST(c_nationkey AS BIGINT) AS role_id,
               (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS date_joined
        FROM customer""",
    "groups_": """
        SELECT DISTINCT CAST(ascii(c_mktsegment) - 64 AS BIGINT) AS id, c_mktsegment AS name FROM customer""",
    "user_groups": """
        SELECT c_custkey AS user_id, CAST(ascii(c_mktsegment) - 64 AS BIGINT) AS group_id FROM customer
        UNION
        SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 8
                          ELSE 13 END
        FROM customer""",
    "user_permissions": """
        SELECT DISTINCT o_custkey AS user_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS permission_id
        FROM orders""",
    "group_permissions": """
        SELECT DISTINCT CAST(ascii(c_mktsegment) - 64 AS BIGINT) AS group_id,
               CAST(c_nationkey AS BIGINT) AS permission_id
        FROM customer""",
    "log": """
        SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id,
               CASE event_id % 6 WHEN 0 THEN 'ring' WHEN 1 THEN 'ECON' WHEN 2 THEN 'red '
                    WHEN 3 THEN 'bolt' WHEN 4 THEN 'brand#1' ELSE 'zz' END AS query_text,
               props AS filters, CAST(props->>'k' AS INTEGER) AS k, ts AS performed_at
        FROM events""",
    "collection": """
        SELECT o_orderkey AS id, o_custkey AS user_id, '/collections/' || o_orderkey AS storage_path_hdfs,
               o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS expires_at
        FROM orders""",
    "member": """
        SELECT l_orderkey AS collection_id, l_partkey AS dataset_id,
               CAST(max(l_discount) AS DECIMAL(5,4)) AS relevance_score,
               l_orderkey % (SELECT count(*) FROM events) AS query_id
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "with_area": "SELECT * FROM dataset WHERE anatomical_area_id IS NOT NULL",
    "text_hit": """
        SELECT * FROM dataset
        WHERE contains(upper(title), 'RIN') OR contains(upper(description), 'RIN')""",
    "detail": """
        SELECT d.id, d.title, d.description, d.external_path, d.local_path, d.record_count, d.size,
               d.anatomical_area_id AS anatomical_area, a.name AS anatomical_area_name,
               coalesce((SELECT string_agg(b.modality_id || ':' || m.name, ',' ORDER BY b.modality_id)
                         FROM dataset_modality b JOIN modality m ON m.id = b.modality_id
                         WHERE b.dataset_id = d.id), '') AS modalities,
               coalesce((SELECT string_agg(b.ml_task_id || ':' || m.name, ',' ORDER BY b.ml_task_id)
                         FROM dataset_ml_task b JOIN ml_task m ON m.id = b.ml_task_id
                         WHERE b.dataset_id = d.id), '') AS ml_tasks,
               coalesce((SELECT string_agg(b.tag_id || ':' || m.name, ',' ORDER BY b.tag_id)
                         FROM dataset_tag b JOIN tag m ON m.id = b.tag_id
                         WHERE b.dataset_id = d.id), '') AS tags,
               d.created_at, d.updated_at
        FROM dataset d LEFT JOIN anatomical_area a ON a.id = d.anatomical_area_id""",
    "save": """
        SELECT id * 7 % 5003 AS id, query_text || ' ' || id AS title, filters AS description,
               k AS record_count, performed_at AS saved_at, id AS save_id
        FROM log""",
    "request": """
        SELECT id AS request_id,
               CASE id % 8 WHEN 0 THEN '  ' || query_text || chr(9) WHEN 1 THEN ' z '
                    WHEN 2 THEN ' ' || chr(10) || ' ' WHEN 3 THEN repeat('q', CAST(id % 60 + 70 AS INTEGER))
                    WHEN 4 THEN NULL ELSE query_text END AS query,
               CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN ' ASIA ' END AS area,
               CASE id % 8 WHEN 5 THEN k || '.0' WHEN 6 THEN k || '.5' WHEN 7 THEN 'many'
                    WHEN 0 THEN ' -' || k ELSE '' END AS least
        FROM log""",
    "search": "SELECT DISTINCT upper(trim(query_text)) AS pattern, k % 40 AS record_count_min FROM log",
    "listed_search": """
        SELECT DISTINCT upper(trim(query_text)) AS pattern,
               CASE WHEN k % 4 <> 0 THEN 'NATION_' || (k % 25) || ',NATION_1' END AS modalities_list,
               CASE WHEN k % 3 = 0 THEN '1-URGENT,none such' END AS ml_tasks_list,
               CASE k % 5 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'ATLANTIS' END AS anatomical_area_name,
               k % 50 AS size_max
        FROM (SELECT query_text, id % 100 AS k FROM log)""",
}

_NEEDS = {
    "with_area": ["dataset"],
    "text_hit": ["dataset"],
    "detail": [
        "anatomical_area", "modality", "ml_task", "tag",
        "dataset", "dataset_modality", "dataset_ml_task", "dataset_tag",
    ],
    "save": ["log"],
    "request": ["log"],
    "search": ["log"],
    "listed_search": ["log"],
}


def _sql(views: str, body: str, more: str = "") -> str:
    """``body`` after the views it needs, and ``more`` views of its own."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in views.split():
        add(name)
    parts = [f"{name} AS ({_VIEWS[name]})" for name in wanted]
    if more:
        parts.append(more)
    return f"WITH {', '.join(parts)} {body}"


_SEARCH_SET = """
    record_count >= 25
    AND EXISTS (SELECT 1 FROM dataset_modality b JOIN modality m ON m.id = b.modality_id
                WHERE b.dataset_id = h.id AND m.name IN ('NATION_1', 'NATION_2', 'NATION_3'))
    AND EXISTS (SELECT 1 FROM dataset_ml_task b JOIN ml_task m ON m.id = b.ml_task_id
                WHERE b.dataset_id = h.id AND m.name IN ('1-URGENT', '2-HIGH', '5-LOW'))"""

_SEARCH_BAG = """
    FROM text_hit h
    JOIN dataset_modality b ON b.dataset_id = h.id JOIN modality m ON m.id = b.modality_id
    JOIN dataset_ml_task t ON t.dataset_id = h.id JOIN ml_task k ON k.id = t.ml_task_id
    WHERE record_count >= 25 AND m.name IN ('NATION_1', 'NATION_2', 'NATION_3')
      AND k.name IN ('1-URGENT', '2-HIGH', '5-LOW')"""

_SEARCH_VIEWS = "text_hit modality ml_task dataset_modality dataset_ml_task"


def _relevance(docs: str, queries: str, id_column: str, k: int = 5) -> str:
    """BM25 as views ending in ``ranked``; ``docs`` is (doc, text), ``queries`` (query_id, query)."""
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""
        doc AS ({docs}),
        tokens AS (SELECT doc, {words.format("text")} AS ws FROM doc),
        token AS (SELECT doc, unnest(ws) AS word FROM tokens),
        stat AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(ws)) AS DOUBLE) / count(*) AS mean FROM tokens),
        asked AS (SELECT DISTINCT query_id, unnest({words.format("query")}) AS word FROM ({queries})),
        tf AS (SELECT doc, word, count(*) AS tf FROM token GROUP BY doc, word),
        df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
        scored AS (
            SELECT query_id, tf.doc, round(sum(
                ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
                / (tf + 1.5 * (0.25 + 0.75 * len(ws) / mean))), 6) AS score
            FROM asked JOIN tf USING (word) JOIN df USING (word) JOIN tokens ON tokens.doc = tf.doc, stat
            GROUP BY query_id, tf.doc),
        ranked AS (
            SELECT query_id, doc AS {id_column}, score,
                   CAST(CAST(score / max(score) OVER (PARTITION BY query_id) AS DECIMAL(5,4)) AS DOUBLE)
                       AS relevance_score,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INTEGER) AS rank
            FROM scored QUALIFY rank <= {k})"""


_DOCUMENT_QUERIES = """
    SELECT * FROM (VALUES (0, 'the by anat'), (1, 'die und der'), (2, 'la de que'), (3, 'thereon'),
                          (4, 'Eauouon à côté')) AS q(query_id, query)"""

_CATALOG_DOCS = "SELECT id AS doc, concat_ws(' ', title, description) AS text FROM dataset"

_BATCH = _sql(
    "search dataset",
    """SELECT pattern, CAST(record_count_min AS BIGINT) AS record_count_min, d.id AS dataset_id
       FROM search JOIN dataset d
         ON (contains(upper(title), pattern) OR contains(upper(description), pattern))
        AND record_count >= record_count_min""",
)


def _count_rows(table: str, column: str, rule: str, source: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, '{table}' AS table_name, CAST({column} AS VARCHAR) AS key, "
        f"count(*) AS n_rows FROM {source} GROUP BY {column}"
    )


_ORPHANED = " UNION ALL ".join(
    _count_rows(
        table,
        "dataset_id",
        "reference dataset_id",
        f"(SELECT dataset_id FROM {view} WHERE dataset_id NOT IN (SELECT id FROM with_area))",
    )
    for table, view in (
        ("dataset_modality", "dataset_modality"),
        ("dataset_ml_task", "dataset_ml_task"),
        ("dataset_tag", "dataset_tag"),
        ("collection_datasets", "member"),
    )
)

ORACLES: dict[str, str] = {
    "icontains_or": _sql("text_hit", "SELECT id, title, description FROM text_hit"),
    "area_exact": _sql(
        "dataset anatomical_area",
        """SELECT d.id, title FROM dataset d JOIN anatomical_area a ON a.id = anatomical_area_id
           WHERE a.name = 'ASIA'""",
    ),
    "range_bounds": _sql(
        "dataset",
        """SELECT id, record_count, size FROM dataset
           WHERE record_count BETWEEN 25 AND 35 AND size BETWEEN 10 AND 40""",
    ),
    "list_any_of": _sql(
        "dataset modality ml_task tag dataset_modality dataset_ml_task dataset_tag",
        """SELECT 'modalities_list' AS parameter, id FROM dataset d WHERE EXISTS (
               SELECT 1 FROM dataset_modality b JOIN modality m ON m.id = b.modality_id
               WHERE b.dataset_id = d.id AND m.name IN ('NATION_1', 'NATION_2', '', ' NATION_4'))
           UNION ALL SELECT 'ml_tasks_list', id FROM dataset d WHERE EXISTS (
               SELECT 1 FROM dataset_ml_task b JOIN ml_task m ON m.id = b.ml_task_id
               WHERE b.dataset_id = d.id AND m.name IN ('1-URGENT', '5-LOW'))
           UNION ALL SELECT 'tags_list', id FROM dataset d WHERE EXISTS (
               SELECT 1 FROM dataset_tag b JOIN tag m ON m.id = b.tag_id
               WHERE b.dataset_id = d.id AND m.name IN ('Supplier#000000001', 'Supplier#000000007'))""",
    ),
    "id_list": _sql(
        "dataset dataset_modality",
        """SELECT id, title FROM dataset WHERE anatomical_area_id = 2
           AND id IN (SELECT dataset_id FROM dataset_modality WHERE modality_id IN (1, 2, 3))""",
    ),
    "equality_fallback": _sql("dataset", "SELECT id, title FROM dataset WHERE title = 'red ring'"),
    "split_items": _sql(
        "dataset",
        """SELECT id, CAST(position - 1 AS INTEGER) AS position, items[position] AS item
           FROM (SELECT id, items, unnest(generate_series(1, len(items))) AS position
                 FROM (SELECT id, string_split(translate(title, ' e', ',,'), ',') AS items FROM dataset))""",
    ),
    "search_set": _sql(
        _SEARCH_VIEWS,
        f"""SELECT id, title, record_count, created_at,
                   row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) - 1 AS position
            FROM text_hit h WHERE {_SEARCH_SET}""",
    ),
    "search_set_size": _sql(
        _SEARCH_VIEWS,
        f"""SELECT id, size, row_number() OVER (ORDER BY size ASC NULLS LAST, id) - 1 AS position
            FROM text_hit h WHERE {_SEARCH_SET} AND size <= 30""",
    ),
    "search_untrimmed": _sql(
        "text_hit anatomical_area",
        """SELECT h.id, title FROM text_hit h JOIN anatomical_area a ON a.id = anatomical_area_id
           WHERE a.name = 'ASIA' AND record_count >= 25""",
    ),
    "search_bag": _sql(_SEARCH_VIEWS, f"SELECT h.id, h.title, h.size {_SEARCH_BAG}"),
    "search_count": _sql(
        _SEARCH_VIEWS,
        f"""SELECT 'intended' AS semantics, count(*) AS count FROM text_hit h
            WHERE {_SEARCH_SET} AND size <= 30
            UNION ALL SELECT 'as_written', count(*) {_SEARCH_BAG}""",
    ),
    "newest": _sql(
        "dataset",
        "SELECT id, title, created_at FROM dataset ORDER BY created_at DESC NULLS FIRST, id LIMIT 5",
    ),
    "oldest": _sql(
        "dataset",
        "SELECT id, title, created_at FROM dataset ORDER BY created_at ASC NULLS LAST, id LIMIT 5",
    ),
    "page": _sql(
        "dataset",
        "SELECT id, created_at FROM dataset ORDER BY created_at DESC NULLS FIRST, id LIMIT 20 OFFSET 20",
    ),
    "page_by_record_count": _sql(
        "dataset",
        "SELECT id, record_count FROM dataset ORDER BY record_count DESC NULLS FIRST, id LIMIT 20 OFFSET 40",
    ),
    "deep_page": _sql(
        "dataset", "SELECT id, title FROM dataset ORDER BY title ASC NULLS LAST, id LIMIT 20 OFFSET 580"
    ),
    "detail_view": _sql("detail", "SELECT * FROM detail"),
    "detail_by_ids": _sql(
        "detail member", "SELECT * FROM detail WHERE id IN (SELECT dataset_id FROM member)"
    ),
    "detail_of_search": _sql(
        "detail text_hit",
        """SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) - 1 AS position
           FROM detail WHERE id IN (SELECT id FROM text_hit WHERE record_count >= 25)""",
    ),
    "response_rows": _sql(
        "dataset anatomical_area modality ml_task tag dataset_modality dataset_ml_task dataset_tag",
        """SELECT d.id, CAST(to_json({
               'id': d.id, 'title': title, 'description': description, 'external_path': external_path,
               'local_path': local_path, 'record_count': record_count, 'size': size,
               'anatomical_area': anatomical_area_id, 'anatomical_area_name': a.name,
               'modalities': coalesce((SELECT list({'id': m.id, 'name': m.name} ORDER BY m.id)
                   FROM dataset_modality b JOIN modality m ON m.id = modality_id WHERE dataset_id = d.id), []),
               'ml_tasks': coalesce((SELECT list({'id': m.id, 'name': m.name} ORDER BY m.id)
                   FROM dataset_ml_task b JOIN ml_task m ON m.id = ml_task_id WHERE dataset_id = d.id), []),
               'tags': coalesce((SELECT list({'id': m.id, 'name': m.name} ORDER BY m.id)
                   FROM dataset_tag b JOIN tag m ON m.id = tag_id WHERE dataset_id = d.id), []),
               'created_at': strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'),
               'updated_at': strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ')}) AS VARCHAR) AS json
           FROM dataset d LEFT JOIN anatomical_area a ON a.id = anatomical_area_id""",
    ),
    "shown_as": _sql(
        "anatomical_area modality ml_task tag dataset",
        " UNION ALL ".join(
            f"SELECT '{table}' AS table_name, id, {column} AS label FROM {table}"
            for table, column in (
                ("anatomical_area", "name"), ("modality", "name"), ("ml_task", "name"), ("tag", "name"),
                ("dataset", "title"),
            )
        ),
    ),
    "users_newest": _sql(
        "users",
        """SELECT id, username, role_id, date_joined,
                  row_number() OVER (ORDER BY date_joined DESC NULLS FIRST, id) - 1 AS position FROM users""",
    ),
    "user_groups": _sql(
        "users user_groups",
        """SELECT id, coalesce((SELECT string_agg(CAST(group_id AS VARCHAR), ',' ORDER BY group_id)
                               FROM user_groups WHERE user_id = id), '') AS groups FROM users""",
    ),
    "user_permissions": _sql(
        "users user_permissions",
        """SELECT id, coalesce((SELECT string_agg(CAST(permission_id AS VARCHAR), ',' ORDER BY permission_id)
                               FROM user_permissions WHERE user_id = id), '') AS permissions FROM users""",
    ),
    "group_permissions": _sql(
        "groups_ group_permissions",
        """SELECT id, name, coalesce((SELECT string_agg(CAST(permission_id AS VARCHAR), ',' ORDER BY permission_id)
                               FROM group_permissions WHERE group_id = id), '') AS permissions FROM groups_""",
    ),
    "groups_by_name": _sql(
        "groups_",
        "SELECT id, name, row_number() OVER (ORDER BY name ASC NULLS LAST, id) - 1 AS position FROM groups_",
    ),
    "account_by_id": _sql(
        "users groups_",
        """SELECT id, username AS name FROM users WHERE id = 42
           UNION ALL SELECT id, name FROM groups_ WHERE id = 13""",
    ),
    "facets": _sql(
        "dataset anatomical_area modality ml_task tag dataset_modality dataset_ml_task dataset_tag",
        """SELECT 'anatomical_area' AS facet, name AS option,
                  (SELECT count(*) FROM dataset WHERE anatomical_area_id = a.id) AS n_datasets,
                  CAST(NULL AS INTEGER) AS low, CAST(NULL AS INTEGER) AS high FROM anatomical_area a
           UNION ALL SELECT 'modalities', name,
                  (SELECT count(DISTINCT dataset_id) FROM dataset_modality WHERE modality_id = m.id), NULL, NULL
                  FROM modality m
           UNION ALL SELECT 'ml_tasks', name,
                  (SELECT count(DISTINCT dataset_id) FROM dataset_ml_task WHERE ml_task_id = m.id), NULL, NULL
                  FROM ml_task m
           UNION ALL SELECT 'tags', name,
                  (SELECT count(DISTINCT dataset_id) FROM dataset_tag WHERE tag_id = m.id), NULL, NULL FROM tag m
           UNION ALL SELECT 'record_count', NULL, count(record_count), min(record_count), max(record_count)
                  FROM dataset
           UNION ALL SELECT 'size', NULL, count(size), min(size), max(size) FROM dataset""",
    ),
    "facets_of_search": _sql(
        "text_hit anatomical_area modality ml_task tag dataset_modality dataset_ml_task dataset_tag",
        """SELECT 'anatomical_area' AS facet, name AS option,
                  (SELECT count(*) FROM text_hit WHERE anatomical_area_id = a.id) AS n_datasets,
                  CAST(NULL AS INTEGER) AS low, CAST(NULL AS INTEGER) AS high FROM anatomical_area a
           UNION ALL SELECT 'modalities', name, (SELECT count(DISTINCT dataset_id) FROM dataset_modality
                  WHERE modality_id = m.id AND dataset_id IN (SELECT id FROM text_hit)), NULL, NULL
                  FROM modality m
           UNION ALL SELECT 'ml_tasks', name, (SELECT count(DISTINCT dataset_id) FROM dataset_ml_task
                  WHERE ml_task_id = m.id AND dataset_id IN (SELECT id FROM text_hit)), NULL, NULL
                  FROM ml_task m
           UNION ALL SELECT 'tags', name, (SELECT count(DISTINCT dataset_id) FROM dataset_tag
                  WHERE tag_id = m.id AND dataset_id IN (SELECT id FROM text_hit)), NULL, NULL FROM tag m
           UNION ALL SELECT 'record_count', NULL, count(record_count), min(record_count), max(record_count)
                  FROM text_hit
           UNION ALL SELECT 'size', NULL, count(size), min(size), max(size) FROM text_hit""",
    ),
    "facets_in_progress": _sql(
        "dataset anatomical_area modality ml_task tag dataset_modality dataset_ml_task dataset_tag",
        """SELECT 'anatomical_area' AS facet, name AS option,
                  (SELECT count(*) FROM met WHERE anatomical_area_id = a.id AND m AND t AND r AND s) AS n_datasets,
                  CAST(NULL AS INTEGER) AS low, CAST(NULL AS INTEGER) AS high FROM anatomical_area a
           UNION ALL SELECT 'modalities', name, (SELECT count(DISTINCT dataset_id) FROM dataset_modality
                  WHERE modality_id = x.id AND dataset_id IN (SELECT id FROM met WHERE t AND r AND s)), NULL, NULL
                  FROM modality x
           UNION ALL SELECT 'ml_tasks', name, (SELECT count(DISTINCT dataset_id) FROM dataset_ml_task
                  WHERE ml_task_id = x.id AND dataset_id IN (SELECT id FROM met WHERE m AND r AND s)), NULL, NULL
                  FROM ml_task x
           UNION ALL SELECT 'tags', name, (SELECT count(DISTINCT dataset_id) FROM dataset_tag
                  WHERE tag_id = x.id AND dataset_id IN (SELECT id FROM met WHERE m AND t AND r AND s)), NULL, NULL
                  FROM tag x
           UNION ALL SELECT 'record_count', NULL, count(record_count), min(record_count), max(record_count)
                  FROM met WHERE m AND t AND s
           UNION ALL SELECT 'size', NULL, count(size), min(size), max(size) FROM met WHERE m AND t AND r""",
        """met AS (
               SELECT id, record_count, size, anatomical_area_id,
                      coalesce(record_count >= 25, false) AS r, coalesce(size <= 30, false) AS s,
                      id IN (SELECT dataset_id FROM dataset_modality JOIN modality y ON y.id = modality_id
                             WHERE name IN ('NATION_1', 'NATION_2', 'NATION_3')) AS m,
                      id IN (SELECT dataset_id FROM dataset_ml_task JOIN ml_task y ON y.id = ml_task_id
                             WHERE name IN ('1-URGENT', '2-HIGH', '5-LOW')) AS t
               FROM dataset WHERE contains(upper(title), 'RIN') OR contains(upper(description), 'RIN'))""",
    ),
    "dup_names": _sql("dataset", _count_rows("dataset", "title", "unique title", "dataset") + " HAVING count(*) > 1"),
    "dup_pairs": _sql(
        "member",
        """SELECT 'unique query_id,dataset_id' AS rule, 'collection_datasets' AS table_name, '["' || query_id || '","' || dataset_id || '"]' AS key,
                  count(*) AS n_rows
           FROM member GROUP BY query_id, dataset_id HAVING count(*) > 1""",
    ),
    "unique_titles": _sql(
        "dataset",
        """SELECT id, title, size FROM dataset
           QUALIFY row_number() OVER (PARTITION BY title ORDER BY id) = 1""",
    ),
    "missing": _sql(
        "dataset",
        " UNION ALL ".join(
            f"""SELECT 'required {name}' AS rule, 'dataset' AS table_name, CAST(id AS VARCHAR) AS key,
                       CAST(1 AS BIGINT) AS n_rows FROM dataset WHERE {name} IS NULL"""
            for name in ("description", "record_count", "anatomical_area_id")
        ),
    ),
    "orphans": _sql(
        "with_area dataset_modality",
        _count_rows(
            "dataset_modality",
            "dataset_id",
            "reference dataset_id",
            "(SELECT dataset_id FROM dataset_modality WHERE dataset_id NOT IN (SELECT id FROM with_area))",
        ),
    ),
    "orphaned_rows": _sql(
        "with_area dataset_tag",
        """SELECT dataset_id, tag_id FROM dataset_tag b
           WHERE NOT EXISTS (SELECT 1 FROM with_area d WHERE d.id = b.dataset_id)""",
    ),
    "all_violations": _sql(
        "with_area dataset_modality dataset_ml_task dataset_tag member anatomical_area user_groups users",
        _ORPHANED
        + "".join(
            f""" UNION ALL SELECT 'required {name}', 'dataset', CAST(id AS VARCHAR), 1 FROM with_area
                WHERE {name} IS NULL"""
            for name in ("created_at", "updated_at")
        )
        + """ UNION ALL SELECT 'unique id', 'anatomical_area', CAST(id AS VARCHAR), 2 FROM anatomical_area
              UNION ALL SELECT 'unique name', 'anatomical_area', name, 3 FROM anatomical_area
              UNION ALL SELECT 'required id', 'anatomical_area', '?', count(*) FROM anatomical_area
              UNION ALL SELECT 'required name', 'anatomical_area', CAST(id + 100 AS VARCHAR), 1 FROM anatomical_area
              UNION ALL SELECT 'length name', 'anatomical_area', CAST(id + 200 AS VARCHAR), 1 FROM anatomical_area
              UNION ALL SELECT 'unique user_id,group_id', 'user_groups',
                        '["' || user_id || '","' || group_id || '"]', 2 FROM user_groups WHERE user_id % 7 = 0
              UNION ALL SELECT 'required group_id', 'user_groups', '["' || user_id || '",null]', count(*)
                        FROM user_groups WHERE user_id % 7 = 1 GROUP BY user_id
              UNION ALL SELECT 'reference role_id', 'users', '-1', count(*) FROM users WHERE id % 11 = 0""",
    ),
    "delete_blocked": _sql(
        "dataset member",
        """SELECT d.id, 'collection_datasets.dataset_id' AS referrer, count(*) AS n_rows
           FROM dataset d JOIN member m ON m.dataset_id = d.id GROUP BY d.id""",
    ),
    "delete_blocked_roles": _sql(
        "roles users",
        """SELECT r.id, 'users.role_id' AS referrer, count(*) AS n_rows
           FROM roles r JOIN users u ON u.role_id = r.id GROUP BY r.id""",
    ),
    "delete_cascade": _sql(
        "with_area dataset_modality dataset_ml_task dataset_tag",
        "SELECT 'dataset' AS table_name, id AS dataset_id, count(*) AS n_rows FROM with_area GROUP BY id"
        + "".join(
            f""" UNION ALL SELECT '{table}', dataset_id, count(*) FROM {table}
                WHERE dataset_id IN (SELECT id FROM with_area) GROUP BY dataset_id"""
            for table in ("dataset_modality", "dataset_ml_task", "dataset_tag")
        ),
    ),
    "delete_set_null": _sql(
        "dataset anatomical_area",
        """SELECT id, CASE WHEN anatomical_area_id NOT IN (
                      SELECT id FROM anatomical_area WHERE starts_with(name, 'A'))
                  THEN anatomical_area_id END AS anatomical_area_id FROM dataset""",
    ),
    "delete_users": _sql(
        "users log collection member",
        """SELECT user_id, count(*) AS n_collections, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_datasets
           FROM collection LEFT JOIN (SELECT collection_id, count(*) AS n FROM member GROUP BY 1)
                ON collection_id = id
           WHERE user_id IN (SELECT user_id FROM log WHERE user_id IS NOT NULL) GROUP BY user_id""",
    ),
    "insert_without_id": _sql(
        "dataset log",
        """SELECT title, description, record_count, created_at, updated_at, false AS fresh, count(*) AS n_rows,
                  count(*) AS n_ids
           FROM dataset GROUP BY ALL
           UNION ALL
           SELECT query_text, filters, k, TIMESTAMP '2025-01-01', TIMESTAMP '2025-01-01', true, count(*), count(*)
           FROM log GROUP BY ALL""",
    ),
    "upsert_latest": _sql(
        "dataset save",
        """SELECT coalesce(s.id, d.id) AS id,
                  CASE WHEN s.id IS NULL THEN d.title ELSE s.title END AS title,
                  CASE WHEN s.id IS NULL THEN d.description ELSE s.description END AS description,
                  CASE WHEN s.id IS NULL THEN d.record_count ELSE s.record_count END AS record_count,
                  CASE WHEN s.id IS NULL THEN d.created_at
                       ELSE coalesce(d.created_at, TIMESTAMP '2025-01-01') END AS created_at,
                  CASE WHEN s.id IS NULL THEN d.updated_at ELSE TIMESTAMP '2025-01-01' END AS updated_at
           FROM dataset d FULL JOIN (
               SELECT * FROM save QUALIFY row_number() OVER (
                   PARTITION BY id ORDER BY saved_at DESC, save_id DESC) = 1) s ON s.id = d.id""",
    ),
    "default_times": _sql(
        "collection",
        """SELECT id, CASE WHEN day(created_at) > 15 THEN created_at ELSE TIMESTAMP '2025-01-01' END AS created_at
           FROM collection""",
    ),
    "assign_ids": _sql(
        "dataset log",
        """SELECT (SELECT max(id) FROM dataset) + 1 AS first_id,
                  (SELECT max(id) FROM dataset) + count(*) AS last_id,
                  count(*) AS n_ids, count(*) AS n_rows FROM log""",
    ),
    "expiry": _sql(
        "collection",
        """SELECT id, made AS created_at, made + INTERVAL 1 DAY AS expires_at
           FROM (SELECT id, CASE WHEN day(created_at) > 1 THEN created_at END AS made FROM collection)""",
    ),
    "archive_size": _sql(
        "member dataset",
        """SELECT collection_id, count(*) AS n_datasets, CAST(coalesce(sum(size), 0) AS BIGINT) AS archive_size_mb
           FROM member JOIN dataset d ON d.id = dataset_id GROUP BY collection_id""",
    ),
    "collection_manifest": _sql(
        "member dataset collection",
        """SELECT c.id AS collection_id, user_id, storage_path_hdfs, count(d.id) AS n_datasets,
                  CAST(coalesce(sum(size), 0) AS BIGINT) AS archive_size_mb, c.created_at, c.expires_at
           FROM collection c LEFT JOIN member ON collection_id = c.id LEFT JOIN dataset d ON d.id = dataset_id
           GROUP BY ALL""",
    ),
    "collection_contents": _sql(
        "member dataset collection log",
        """SELECT collection_id, c.user_id AS owner_id, dataset_id, title, size,
                  CAST(relevance_score AS DOUBLE) AS relevance_score, query_id, query_text
           FROM member JOIN dataset d ON d.id = dataset_id JOIN log q ON q.id = query_id
                JOIN collection c ON c.id = collection_id""",
    ),
    "archive_contents": _sql(
        "member dataset",
        """SELECT collection_id, dataset_id, title, size FROM member JOIN dataset d ON d.id = dataset_id""",
    ),
    "built_collections": _sql(
        "dataset log",
        """SELECT user_id, TIMESTAMP '2025-01-01' AS created_at, TIMESTAMP '2025-01-02' AS expires_at,
                  count(DISTINCT query_id) AS n_collections, CAST(sum(size) AS BIGINT) AS total_mb
           FROM (SELECT DISTINCT user_id, query_text FROM log WHERE user_id IS NOT NULL)
                JOIN ranked ON query_id = query_text JOIN dataset d ON d.id = ranked.dataset_id
           GROUP BY user_id""",
        _relevance(
            _CATALOG_DOCS, "SELECT DISTINCT query_text AS query_id, query_text AS query FROM log", "dataset_id"
        ),
    ),
    "built_headers": _sql(
        "dataset log",
        """SELECT user_id, CAST(sum(size) AS BIGINT) AS archive_size_mb, TIMESTAMP '2025-01-01' AS created_at,
                  TIMESTAMP '2025-01-02' AS expires_at, true AS path_fits
           FROM (SELECT DISTINCT user_id, query_text FROM log WHERE user_id IS NOT NULL)
                JOIN ranked ON query_id = query_text JOIN dataset d ON d.id = ranked.dataset_id
           GROUP BY user_id, query_text""",
        _relevance(
            _CATALOG_DOCS, "SELECT DISTINCT query_text AS query_id, query_text AS query FROM log", "dataset_id"
        ),
    ),
    "built_members": _sql(
        "log dataset",
        """SELECT a.user_id, t.query_id, r.dataset_id, r.relevance_score
           FROM (SELECT DISTINCT user_id, query_text FROM log WHERE user_id IS NOT NULL) a
                JOIN (SELECT query_text, min(id) AS query_id FROM log GROUP BY query_text) t USING (query_text)
                JOIN ranked r ON r.query_id = a.query_text""",
        _relevance(
            _CATALOG_DOCS, "SELECT DISTINCT query_text AS query_id, query_text AS query FROM log", "dataset_id"
        ),
    ),
    "log_numbered": _sql(
        "log",
        """SELECT user_id, query_text, count(*) AS n_rows, (SELECT count(*) FROM log) AS n_ids,
                  CAST(1 AS BIGINT) AS first_id, (SELECT count(*) FROM log) AS last_id
           FROM log GROUP BY user_id, query_text""",
    ),
    "log_filters": _sql("log", "SELECT id, k AS value FROM log"),
    "log_append": _sql(
        "log",
        """SELECT user_id, query_text, TIMESTAMP '2025-01-01' AS performed_at, count(*) AS n_rows
           FROM log GROUP BY user_id, query_text""",
    ),
    "request_validity": _sql(
        "request",
        """SELECT request_id, concat_ws(',',
                  CASE WHEN query IS NULL
                         OR length(trim(query, ' ' || chr(9) || chr(10))) NOT BETWEEN 2 AND 100
                       THEN 'query' END,
                  CASE WHEN length(trim(area)) = 1 THEN 'anatomical_area_name' END,
                  CASE WHEN trim(least) <> '' AND NOT regexp_full_match(trim(least), '[+-]?[0-9]+(\\.0*)?')
                       THEN 'record_count_min' END) AS errors
           FROM request""",
    ),
    "saved_requests": _sql(
        "log",
        """SELECT id, query_text, CASE WHEN id % 2 = 0 THEN CAST(k AS VARCHAR) END AS record_count_min,
                  CAST(NULL AS VARCHAR) AS size_max, CASE WHEN id % 2 = 0 THEN 'CT,MRI' END AS modalities_list,
                  CASE WHEN id % 2 = 0 THEN 'a,b' END AS tags_list,
                  CASE WHEN id % 2 = 0 THEN 'size' END AS ordering FROM log""",
    ),
    "batch_search": _BATCH,
    "batch_search_shuffled": _BATCH,
    "batch_search_lists": _sql(
        "listed_search dataset anatomical_area modality ml_task dataset_modality dataset_ml_task",
        """SELECT pattern, modalities_list, ml_tasks_list, s.anatomical_area_name,
                  CAST(size_max AS BIGINT) AS size_max, d.id AS dataset_id
           FROM listed_search s JOIN dataset d
             ON (contains(upper(title), pattern) OR contains(upper(description), pattern))
            AND size <= size_max
           LEFT JOIN anatomical_area a ON a.id = d.anatomical_area_id
           WHERE (s.anatomical_area_name IS NULL OR s.anatomical_area_name = a.name)
             AND (modalities_list IS NULL OR EXISTS (
                  SELECT 1 FROM dataset_modality b JOIN modality m ON m.id = b.modality_id
                  WHERE b.dataset_id = d.id AND list_contains(string_split(modalities_list, ','), m.name)))
             AND (ml_tasks_list IS NULL OR EXISTS (
                  SELECT 1 FROM dataset_ml_task b JOIN ml_task m ON m.id = b.ml_task_id
                  WHERE b.dataset_id = d.id AND list_contains(string_split(ml_tasks_list, ','), m.name)))""",
    ),
    "batch_ordered": _sql(
        "log dataset",
        " UNION ALL ".join(
            f"""SELECT pattern, CAST(record_count_min AS BIGINT) AS record_count_min, '{column}' AS order_by,
                       {down} AS descending, d.id AS dataset_id,
                       row_number() OVER (PARTITION BY pattern, record_count_min ORDER BY {order}, d.id) - 1 AS position
                FROM (SELECT DISTINCT upper(trim(query_text)) AS pattern, k % 40 AS record_count_min FROM log
                      WHERE id % 4 = {turn}) s
                JOIN dataset d ON (contains(upper(title), pattern) OR contains(upper(description), pattern))
                     AND record_count >= record_count_min"""
            for turn, column, down, order in (
                (0, "size", "false", "size ASC NULLS LAST"),
                (1, "title", "true", "title DESC NULLS FIRST"),
                (2, "record_count", "true", "record_count DESC NULLS FIRST"),
                (3, "created_at", "true", "created_at DESC NULLS FIRST"),
            )
        ),
    ),
    "batch_counts": _sql(
        "search dataset log",
        """SELECT l.id AS request_id, coalesce(n, 0) AS count FROM log l LEFT JOIN (
               SELECT pattern, record_count_min, count(*) AS n FROM search JOIN dataset
                 ON (contains(upper(title), pattern) OR contains(upper(description), pattern))
                AND record_count >= record_count_min
               GROUP BY pattern, record_count_min) f
             ON f.pattern = upper(trim(l.query_text)) AND f.record_count_min = l.k % 40""",
    ),
    "relevance_top5": _sql(
        "dataset log",
        "SELECT * FROM ranked",
        _relevance(_CATALOG_DOCS, "SELECT DISTINCT query_text AS query_id, query_text AS query FROM log", "id"),
    ),
    "relevance_documents": "WITH "
    + _relevance(
        "SELECT doc_id AS doc, text FROM documents",
        _DOCUMENT_QUERIES,
        "doc_id",
    )
    + " SELECT * FROM ranked",
    "relevance_many": "WITH "
    + _relevance("SELECT doc_id AS doc, text FROM documents", _DOCUMENT_QUERIES, "doc_id", 2000)
    + " SELECT * FROM ranked",
    "batch_search_words": _sql(
        "dataset",
        """SELECT pattern, d.id AS dataset_id
           FROM asked JOIN dataset d ON contains(upper(title), pattern) OR contains(upper(description), pattern)""",
        """asked AS (
               SELECT DISTINCT upper(replace(word, 'ß', 'SS')) AS pattern
               FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents)
               WHERE length(word) BETWEEN 2 AND 100)""",
    ),
    "too_long": """
        SELECT 'length text' AS rule, 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS key,
               CAST(1 AS BIGINT) AS n_rows FROM documents WHERE length(text) > 500
        UNION ALL SELECT 'length source', 'documents', CAST(doc_id AS VARCHAR), 1
        FROM documents WHERE length(source) > 3""",
}
