"""The registered queries as DuckDB SQL over the star-schema views.

Every statement derives its inputs from the views again, by other means than the
Spark side: the flat catalog comes straight from the template, positions are
joins, and arrays are rows.
"""

from __future__ import annotations

from string import Formatter

from sqlloom.plans import fixtures as X
from sqlloom.plans import templates as T


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def render(template: str, **slots: str) -> str:
    """SQL expression that fills the slots of a template."""
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if slot is not None:
            parts.append(slots[slot])
    return " || ".join(parts)


def _filled(text: str) -> str:
    return f"replace({lit(text)}, '{{u}}', user_id::VARCHAR)"


def _by_modulus(texts: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {_filled(t)}" for i, t in enumerate(texts))
    return f"CASE question_id % {len(texts)} {cases} END"


def _by_type(pick: int) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {_filled(v[pick])}" for k, v in X.QUESTION_TEMPLATES.items())
    return f"CASE event_type {cases} END"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


# The keywords that the reasoning parser raises, stated here again so that a wrong list shows.
_RAISED = ["select", "from", "where", "join", "on", "group by", "order by", "limit", "having", "count", "sum", "avg", "min", "max"]
_QUERY_WORDS = [
    "all", "and", "as", "asc", "avg", "between", "by", "case", "cast", "count", "cross", "desc", "distinct", "else", "end", "except",
    "exists", "first", "from", "full", "group", "having", "in", "inner", "intersect", "is", "join", "last", "left", "like", "limit",
    "max", "min", "natural", "not", "null", "nulls", "offset", "on", "or", "order", "outer", "right", "select", "sum", "then", "union",
    "using", "when", "where", "with",
]


def _upper(x: str, words: list[str] = _RAISED) -> str:
    for word in words:
        x = rf"regexp_replace({x}, '\b{word}\b', '{word.upper()}', 'gi')"
    return x


def _quoted_apart(x: str, outside: str, inside: str) -> str:
    """Rewrite the pieces ``p`` of a text outside and inside single quotes."""
    return (f"array_to_string(list_transform(string_split({x}, chr(39)), "
            f"lambda p, i: CASE WHEN i % 2 = 1 THEN {outside} ELSE {inside} END), chr(39))")


def _normalise(x: str) -> str:
    plain = _upper(r"regexp_replace(p, '\s+', ' ', 'g')", _QUERY_WORDS)
    return rf"trim(regexp_replace(trim({_quoted_apart(x, plain, 'p')}), '[; ]+$', ''))"


_NL = "chr(10)"


def _parsed(source: str) -> str:
    """Reasoning, SQL and status of a response table, by the places of the tags in the lower-cased response.

    ``a`` is where the reasoning begins; ``b``, ``c`` and ``d`` are the places of the next three tags, each
    counted from the one before and 0 where it is missing.
    """
    steps = {
        "low": "lower(response)",
        "tag": "CASE WHEN contains(response, '<chains>') THEN 'chains' WHEN contains(response, '<REASONING>') THEN 'reasoning' END",
        "a": "strpos(low, '<' || tag || '>') + length(tag) + 2",
        "b": "strpos(substr(low, a), '</' || tag || '>')",
        "c": "strpos(substr(low, a + b), '<sql>')",
        "d": "strpos(substr(low, a + b + c + 4), '</sql>')",
        "status": "CASE WHEN tag IS NULL THEN 'no_tags' WHEN least(b, c, d) > 0 THEN 'ok' ELSE 'unclosed' END",
    }
    rows = source
    for name, value in steps.items():
        rows = f"(SELECT *, {value} AS {name} FROM {rows})"
    return f"""SELECT question_id,
        CASE status WHEN 'ok' THEN {_collapse('substr(response, a, b - 1)')} WHEN 'unclosed' THEN {_strip('response')} END AS reasoning,
        CASE status WHEN 'ok' THEN {_upper(_collapse('substr(response, a + b + c + 4, d - 1)'))} WHEN 'unclosed' THEN 'SELECT' END AS sql,
        status AS parse_status
    FROM {rows}"""


_TABLE_ROWS = [(t, name) for t, name in enumerate(X.TABLES)]
_COLUMN_ROWS = [
    (t, name, p, c, ty) for t, (name, cols) in enumerate(X.TABLES.items()) for p, (c, ty) in enumerate(cols)
]
_PK_ROWS = [(i, *k.split(".")) for i, k in enumerate(X.PRIMARY_KEYS)]
_FK_ROWS = [(i, *a.split("."), *b.split(".")) for i, (a, b) in enumerate(X.FOREIGN_KEYS)]

# Named sub-queries in dependency order; a statement takes the ones its text mentions.
CTES: dict[str, str] = {
    "tpl_t": f"SELECT * FROM (VALUES {_values(_TABLE_ROWS)}) v(t, tname)",
    "tpl_c": f"SELECT * FROM (VALUES {_values(_COLUMN_ROWS)}) v(t, tname, p, cname, ctype)",
    "tpl_pk": f"SELECT * FROM (VALUES {_values(_PK_ROWS)}) v(i, tname, cname)",
    "tpl_fk": f"SELECT * FROM (VALUES {_values(_FK_ROWS)}) v(i, lt, lc, rt, rc)",
    "dbs": "SELECT c_custkey AS c, 'db_' || c_custkey AS db_id FROM customer",
    "dbt": """SELECT c, db_id, t, tname, (row_number() OVER (PARTITION BY c ORDER BY t) - 1)::INTEGER AS tab_idx
        FROM dbs, tpl_t WHERE (c + t) % 3 <> 0""",
    "dbc": """SELECT c, db_id, tab_idx, dbt.t, dbt.tname,
            (row_number() OVER (PARTITION BY c ORDER BY dbt.t, p))::INTEGER AS col_idx, cname, ctype
        FROM dbt JOIN tpl_c ON dbt.t = tpl_c.t""",
    "pks": """SELECT c, db_id, (row_number() OVER (PARTITION BY c ORDER BY i) - 1)::INTEGER AS pk_pos,
            dbc.tname, dbc.cname, col_idx
        FROM dbc JOIN tpl_pk ON dbc.tname = tpl_pk.tname AND dbc.cname = tpl_pk.cname""",
    "fks": """SELECT l.c, l.db_id, (row_number() OVER (PARTITION BY l.c ORDER BY i) - 1)::INTEGER AS fk_pos,
            lt, lc, rt, rc, l.col_idx AS l_idx, r.col_idx AS r_idx
        FROM tpl_fk JOIN dbc l ON l.tname = lt AND l.cname = lc JOIN dbc r ON r.tname = rt AND r.cname = rc AND r.c = l.c""",
    "fields": f"""SELECT db_id, string_agg('Table ' || tname || ', columns = [*,' || cols || ']' || {_NL}, '' ORDER BY tname) AS fields
        FROM (SELECT db_id, tname, string_agg(cname, ',' ORDER BY col_idx) AS cols FROM dbc GROUP BY ALL) GROUP BY db_id""",
    "pk_text": "SELECT db_id, '[' || string_agg(tname || '.' || cname, ',' ORDER BY pk_pos) || ']' AS primary_keys FROM pks GROUP BY db_id",
    "fk_text": """SELECT db_id, '[' || string_agg(lt || '.' || lc || ' = ' || rt || '.' || rc, ',' ORDER BY fk_pos) || ']' AS foreign_keys
        FROM fks GROUP BY db_id""",
    "typed": f"""SELECT t.db_id, t.text || 'foreign keys :' || {_NL} || f.text AS typed_schema FROM
        (SELECT db_id, string_agg('table ' || tname || ' , columns = [ ' || cols || ' ]' || {_NL}, '' ORDER BY tab_idx) AS text FROM
            (SELECT dbc.db_id, dbc.tname, dbc.tab_idx, string_agg(dbc.tname || '.' || dbc.cname || ' ( ' || ctype ||
                CASE WHEN pks.cname IS NULL THEN '' ELSE ' | primary key' END || ' )', ' , ' ORDER BY dbc.col_idx) AS cols
             FROM dbc LEFT JOIN pks ON pks.c = dbc.c AND pks.col_idx = dbc.col_idx GROUP BY ALL) GROUP BY db_id) t
        JOIN (SELECT db_id, string_agg(lt || '.' || lc || ' = ' || rt || '.' || rc, {_NL} ORDER BY fk_pos) AS text FROM fks GROUP BY db_id) f
        ON t.db_id = f.db_id""",
    "linking": f"""SELECT t.db_id, 'Database Schema:' || {_NL} || t.text AS schema_text,
            'Foreign Keys:' || {_NL} || f.bullets || {_NL} || 'Foreign_keys = ' || f.line AS fk_text FROM
        (SELECT db_id, string_agg('Table ' || tname || ', columns = [' || cols || ']' || {_NL}, '' ORDER BY tab_idx) AS text FROM
            (SELECT db_id, tname, tab_idx, string_agg(cname, ',' ORDER BY col_idx) AS cols FROM dbc GROUP BY ALL) GROUP BY db_id) t
        JOIN (SELECT db_id, string_agg('- ' || lt || '.' || lc || ' = ' || rt || '.' || rc || {_NL}, '' ORDER BY fk_pos) AS bullets,
                '[' || string_agg(lt || '.' || lc || ' = ' || rt || '.' || rc, ',' ORDER BY fk_pos) || ']' AS line FROM fks GROUP BY db_id) f
        ON t.db_id = f.db_id""",
    "ev": "SELECT event_id AS question_id, user_id, event_type FROM events",
    "q": f"""SELECT question_id, CASE WHEN question_id % 97 = 0 THEN 'db_missing'
            ELSE 'db_' || (question_id % (SELECT count(*) FROM customer)) END AS db_id,
            {_by_type(0)} AS question, {_by_type(1)} AS query FROM ev""",
    "link_resp": f"SELECT question_id, {_by_modulus(X.LINK_RESPONSES)} AS response FROM ev",
    "class_resp": f"SELECT question_id, {_by_modulus(X.CLASS_RESPONSES)} AS response FROM ev",
    "sql_resp": f"SELECT question_id, {_by_modulus(X.SQL_RESPONSES)} AS response FROM ev",
    "fixed_resp": f"""SELECT question_id, CASE WHEN question_id % 4 = 0 THEN {_filled(X._CORRECTED)}
            WHEN question_id % 5 = 1 THEN '' ELSE {_by_modulus(X.SQL_RESPONSES)} END AS response FROM ev""",
    "links": r"""SELECT question_id, '[' || replace(replace(trim(trim(
            regexp_extract(response, '(?m)^\s*Schema Links:(.*)$', 1)), '[]()* '), '**', ''), '`', '') || ']' AS schema_links
        FROM link_resp""",
    "link_rows": r"""SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY i) - 1)::INTEGER AS pos, link,
            CASE WHEN contains(link, '=') THEN 'join' WHEN contains(link, '.') THEN 'column' ELSE 'value' END AS kind,
            CASE WHEN NOT contains(link, '=') THEN CASE WHEN contains(link, '.') THEN link END
                 WHEN len(string_split(link, '=')) = 2 THEN trim(string_split(link, '=')[1]) END AS left_item,
            CASE WHEN len(string_split(link, '=')) = 2 THEN trim(string_split(link, '=')[2]) END AS right_item
        FROM (SELECT question_id, i, trim(raw) AS link FROM
            (SELECT question_id, unnest(string_split(trim(schema_links, '[]'), ',')) AS raw,
                    unnest(range(len(string_split(trim(schema_links, '[]'), ',')))) AS i FROM links))
        WHERE link <> ''""",
    "class_labels": """SELECT question_id, classification, CASE WHEN classification IN ('EASY', 'NON-NESTED') THEN classification
            ELSE 'NESTED' END AS class_norm FROM
        (SELECT question_id, CASE WHEN contains(response, 'Label: "') THEN regexp_extract(response, 'Label: "([^"]*)', 1)
            ELSE 'NESTED' END AS classification FROM class_resp)""",
    "parsed": _parsed("sql_resp"),
    "fixed": _parsed("fixed_resp"),
    "gold_class": r"""SELECT question_id, query, CASE
            WHEN regexp_matches(query, '(?i)\b(INTERSECT|UNION|EXCEPT)\b') OR regexp_matches(query, '(?i)\(\s*SELECT\b') THEN 'NESTED'
            WHEN regexp_matches(query, '(?i)\bJOIN\b') THEN 'NON-NESTED' ELSE 'EASY' END AS sql_class FROM q""",
    "gens": f"""SELECT question_id, beam, 'Example <SQL>SELECT 1</SQL> and <SQL>SELECT 2</SQL>' || {_NL} || question || {_NL} ||
            CASE question_id % 4 WHEN 1 THEN '<SQL>' || {_NL} || query || ' LIMIT 5' || {_NL} || '</SQL>' WHEN 2 THEN 'no answer'
                WHEN 3 THEN '<SQL> ' || replace(lower(query), ' ', '  ') || '; </SQL>' ELSE '<SQL>' || query || '</SQL>' END ||
            CASE WHEN beam = 0 THEN '' ELSE ' beam ' || beam END AS output
        FROM q, (VALUES (0), (1), (2), (3)) b(beam)""",
    "gen_sql": f"""SELECT question_id, beam, {_strip("regexp_extract_all(output, '(?s)<SQL>(.*?)</SQL>', 1)[3]")} AS model_predicted_sql
        FROM gens""",
    "pairs": """SELECT q.question_id, q.db_id, q.query AS gold_sql, g.model_predicted_sql AS pred_sql
        FROM q LEFT JOIN gen_sql g ON g.question_id = q.question_id AND g.beam = 0""",
    "exact": f"""SELECT question_id, db_id, gold_norm, pred_norm, coalesce(gold_norm = pred_norm, false) AS exact FROM
        (SELECT question_id, db_id, {_normalise('gold_sql')} AS gold_norm, {_normalise('pred_sql')} AS pred_norm FROM pairs)""",
    "scores": """SELECT event_id AS question_id, quality AS score FROM events
        JOIN labels ON doc_id = event_id % (SELECT count(*) FROM documents)""",
    "ann": """SELECT q.question_id, question, schema_links, fields, foreign_keys, classification, sql AS predicted_sql,
            query AS gold_sql, q.db_id, reasoning
        FROM q JOIN links USING (question_id) JOIN class_labels USING (question_id) JOIN parsed USING (question_id)
        JOIN fields ON fields.db_id = q.db_id JOIN fk_text ON fk_text.db_id = q.db_id WHERE sql IS NOT NULL""",
    "valid": "SELECT ann.* FROM ann JOIN scores USING (question_id) WHERE score = 1",
    "sft": f"""SELECT question_id, classification,
            {render(T.TASK, question='question', schema="'Fields:' || chr(10) || fields || chr(10) || 'Schema_links:' || schema_links")} AS text,
            {render(T.TARGET, reasoning='reasoning', sql='predicted_sql')} AS labels FROM valid""",
    "single": f"""SELECT question_id, classification, {render(T.SINGLE_TEXT, question='question', schema='fields', sql='predicted_sql',
            reasoning=_strip("regexp_replace(reasoning, '([0-9][.])', chr(10) || chr(92) || '1', 'g')"))} AS text_to_sql FROM valid""",
    "link_prompts": f"""SELECT question_id, {render(T.SCHEMA_LINK, question='question', schema_text='schema_text', fk_text='fk_text')} AS prompt
        FROM q JOIN linking USING (db_id)""",
    "hashed": "SELECT question_id, sha256(prompt) AS prompt_hash, prompt FROM link_prompts",
    "asked": "SELECT prompt_hash, min(question_id) AS k FROM hashed GROUP BY prompt_hash HAVING min(question_id) % 11 <> 0",
    "completions": """SELECT prompt_hash, a::INTEGER AS attempt, CASE WHEN k % 4 >= a AND a < 3 THEN 'error' ELSE 'ok' END AS status,
            CASE WHEN k % 4 >= a AND a < 3 THEN NULL ELSE 'answer to ' || k END AS completion
        FROM asked, (VALUES (1), (2), (3)) v(a) WHERE k % 4 >= a - 1""",
    "items": """SELECT db_id, tab_idx, tname AS table_name, NULL::INTEGER AS col_idx, NULL::VARCHAR AS column_name, tname AS name FROM dbt
        UNION ALL SELECT db_id, tab_idx, tname, col_idx, cname, cname FROM dbc""",
    "item_tokens": """SELECT DISTINCT db_id, tab_idx, col_idx, token FROM
        (SELECT db_id, tab_idx, col_idx, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS token FROM items) WHERE token <> ''""",
    "asked_tokens": """SELECT DISTINCT question_id, db_id, token FROM
        (SELECT question_id, db_id, unnest(string_split_regex(lower(question), '[^a-z0-9]+')) AS token FROM q) WHERE token <> ''""",
    "weighted": """SELECT db_id, token, tab_idx, coalesce(col_idx, -1) AS k, 1::DOUBLE / count(*) OVER (PARTITION BY db_id, token) AS w FROM item_tokens""",
    "hits": """SELECT question_id, tab_idx, k, sum(w) AS s FROM asked_tokens JOIN weighted USING (db_id, token) GROUP BY ALL""",
    "item_score": """SELECT q.question_id, i.tab_idx, i.table_name, i.col_idx, i.column_name, round(coalesce(h.s, 0), 6) AS score
        FROM q JOIN items i ON i.db_id = q.db_id LEFT JOIN hits h ON h.question_id = q.question_id AND h.tab_idx = i.tab_idx
            AND h.k = coalesce(i.col_idx, -1)""",
    "outside_score": """SELECT q.question_id, i.tab_idx, i.table_name, i.col_idx, i.column_name,
            ((q.question_id * 31 + coalesce(i.col_idx, i.tab_idx) * 17) % 101) / 100::DOUBLE AS score
        FROM q JOIN items i ON i.db_id = q.db_id""",
}


def _ranked(score: str, k_tables: int, k_columns: int) -> tuple[str, str]:
    tables = f"""SELECT question_id, table_rank, tab_idx, table_name, score FROM (SELECT *, (row_number() OVER
        (PARTITION BY question_id ORDER BY score DESC, tab_idx))::INTEGER AS table_rank FROM {score} WHERE col_idx IS NULL)
        WHERE table_rank <= {k_tables}"""
    columns = f"""SELECT c.question_id, t.table_rank, c.table_name, c.column_rank, c.column_name, c.score FROM
        (SELECT *, (row_number() OVER (PARTITION BY question_id, tab_idx ORDER BY score DESC, col_idx))::INTEGER AS column_rank
         FROM {score} WHERE col_idx IS NOT NULL) c JOIN ({tables}) t ON t.question_id = c.question_id AND t.tab_idx = c.tab_idx
        WHERE column_rank <= {k_columns}"""
    return tables, columns


def _accuracy(matches: str) -> str:
    """Accuracy of rows (question_id, db_id, ok) by class, by database and in total."""
    return f"""SELECT CASE grouping(classification, db_id) WHEN 1 THEN 'class' WHEN 2 THEN 'database' ELSE 'total' END AS level,
            classification, db_id, count(*) AS n, count(*) FILTER (ok) AS n_match, round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS accuracy
        FROM ({matches}) JOIN class_labels USING (question_id) GROUP BY GROUPING SETS ((classification), (db_id), ())"""


_TOP_TABLES, _TOP_COLUMNS = _ranked("item_score", 6, 10)
_THREE_TABLES, _ = _ranked("item_score", 3, 10)
_EXT_TABLES, _EXT_COLUMNS = _ranked("outside_score", 3, 4)


def _clause_sql() -> str:
    """Parts of each clause as lists, then set sizes.  A derived query has one sub-query at most."""
    def bodies(query: str) -> dict[str, str]:
        def body(start: str, *ends: str) -> str:
            return f"regexp_extract({query}, '{start}(.*?)({'|'.join([*ends, '$'])})', 1)"

        where = body(" where ", " group by ", " having ", " order by ", " limit ")
        having = body(" having ", " order by ", " limit ")
        return {
            "select": f"string_split({body('^select ', ' from ')}, ',')",
            "from": f"string_split_regex({body(' from ', ' where ', ' group by ', ' having ', ' order by ', ' limit ')}, ' join |,')",
            "where": f"string_split_regex({where}, ' and | or ')",
            "group": f"string_split({body(' group by ', ' having ', ' order by ', ' limit ')}, ',')",
            "having": f"string_split_regex({having}, ' and | or ')",
            "order": f"string_split({body(' order by ', ' limit ')}, ',')",
            "connective": f"regexp_extract_all({where} || ' ' || {having}, ' (and|or) ', 1)",
        }

    inner = [f"list_transform(list_filter({parts}, lambda x: trim(x) <> ''), lambda x: {lit(n)} || ' ' || trim(x))" for n, parts in bodies("sub").items()]
    lists = bodies("one") | {"set": "[tail]", "nested": f"flatten([{', '.join(inner)}])"}
    sides = " UNION ALL ".join(
        f"SELECT question_id, {lit(n)} AS clause, side, unnest({parts}) AS part FROM cut" for n, parts in lists.items())
    names = ", ".join(f"({lit(n)})" for n in lists)
    word = "' (union|intersect|except) '"
    masked = _quoted_apart(_normalise("s"), "lower(p)", "hex(p)")
    return f"""SELECT question_id, clause,
            round(CASE WHEN ng = 0 AND np = 0 THEN 1 WHEN np = 0 THEN 0 ELSE b::DOUBLE / np END, 6)::DOUBLE AS precision,
            round(CASE WHEN ng = 0 AND np = 0 THEN 1 WHEN ng = 0 THEN 0 ELSE b::DOUBLE / ng END, 6)::DOUBLE AS recall,
            round(CASE WHEN ng = 0 AND np = 0 THEN 1 ELSE 2 * b::DOUBLE / (ng + np) END, 6)::DOUBLE AS f1
        FROM (
            WITH both_sides AS (SELECT question_id, 'g' AS side, gold_sql AS s FROM pairs
                UNION ALL SELECT question_id, 'p', coalesce(pred_sql, '') FROM pairs),
            norm AS (SELECT question_id, side, regexp_replace({masked}, ' between (\\S+) and ', ' between \\1 ~ ', 'g') AS t FROM both_sides),
            split_ AS (SELECT *, string_split_regex(t, {word})[1] AS head FROM norm),
            outer_ AS (SELECT question_id, side, CASE WHEN closed THEN substr(t, length(head) + 1) ELSE '' END AS tail,
                    regexp_replace(CASE WHEN closed THEN head ELSE t END, '^select distinct ', 'select distinct,') AS one
                FROM (SELECT *, length(replace(head, '(', '')) = length(replace(head, ')', '')) AS closed FROM split_)),
            cut AS (SELECT question_id, side, tail, regexp_replace(one, '\\(select [^()]*(\\([^()]*\\)[^()]*)*\\)', '(query)') AS one,
                    regexp_extract(one, '\\((select [^()]*(\\([^()]*\\)[^()]*)*)\\)', 1) AS sub FROM outer_),
            rows_ AS (SELECT DISTINCT question_id, clause, side, lower(trim(part)) AS part FROM ({sides}) WHERE trim(part) <> ''),
            one AS (SELECT question_id, clause, part, count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'p') AS p
                    FROM rows_ GROUP BY ALL)
            SELECT a.question_id, a.clause, coalesce(sum(g), 0) AS ng, coalesce(sum(p), 0) AS np, coalesce(sum(g * p), 0) AS b
            FROM (SELECT question_id, clause FROM ev, (VALUES {names}) v(clause)) a LEFT JOIN one USING (question_id, clause)
            GROUP BY ALL)"""


_YEAR = "year(o_orderdate)"
_D = "::DECIMAL(18,2)"


def _mean(c: str) -> str:
    return f"sum({c}{_D})::DOUBLE / count({c})"


def _top(inner: str, k: int, order: str) -> str:
    return f"SELECT *, (row_number() OVER (ORDER BY {order}))::INTEGER AS rank FROM ({inner}) ORDER BY {order} LIMIT {k}"


_EXECUTION = """WITH c AS (SELECT c_nationkey::BIGINT AS query_id, c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS lo FROM customer),
    n AS (SELECT query_id, CASE WHEN c_custkey <> lo OR query_id % 3 = 0 THEN 1 WHEN query_id % 3 = 1 THEN 2 ELSE 0 END AS copies FROM c)
    SELECT query_id, coalesce(sum(greatest(1 - copies, 0)), 0)::BIGINT AS n_missing,
        coalesce(sum(greatest(copies - 1, 0)), 0)::BIGINT AS n_extra, coalesce(bool_and(copies = 1), true) AS matches
    FROM (SELECT n_nationkey::BIGINT AS query_id FROM nation UNION ALL SELECT r_regionkey + 100 FROM region) ran
    LEFT JOIN n USING (query_id) GROUP BY query_id"""

STATEMENTS: dict[str, str] = {
    "read_catalog": """SELECT d.db_id, t.names AS table_names_original, '-1:*,' || c.cols AS column_names_original,
            'text,' || c.types AS column_types,
            p.keys || CASE WHEN d.c % 50 = 0 THEN ',999' ELSE '' END AS primary_keys,
            f.keys || CASE d.c % 50 WHEN 1 THEN ',999:1' WHEN 2 THEN ',0:1' ELSE '' END AS foreign_keys
        FROM dbs d
        JOIN (SELECT c, string_agg(tname, ',' ORDER BY tab_idx) AS names FROM dbt GROUP BY c) t ON t.c = d.c
        JOIN (SELECT c, string_agg(tab_idx || ':' || cname, ',' ORDER BY col_idx) AS cols,
                string_agg(ctype, ',' ORDER BY col_idx) AS types FROM dbc GROUP BY c) c ON c.c = d.c
        JOIN (SELECT c, string_agg(col_idx, ',' ORDER BY pk_pos) AS keys FROM pks GROUP BY c) p ON p.c = d.c
        JOIN (SELECT c, string_agg(l_idx || ':' || r_idx, ',' ORDER BY fk_pos) AS keys FROM fks GROUP BY c) f ON f.c = d.c""",
    "read_questions": "SELECT question_id, db_id AS database, question, query AS sql FROM q",
    "read_columnar_json": "SELECT question_id AS idx, db_id, question, query FROM q",
    "read_predictions_csv": """SELECT question_id, question, schema_links, model_predicted_sql
        FROM q JOIN links USING (question_id) JOIN gen_sql USING (question_id) WHERE beam = 0""",
    "write_annotations": "SELECT * FROM ann",
    "unpivot_export": """SELECT question_id, 'db_id' AS column_name, db_id AS value FROM q
        UNION ALL SELECT question_id, 'question', question FROM q UNION ALL SELECT question_id, 'query', query FROM q""",
    "write_eval_pairs": "SELECT question_id, coalesce(pred_sql, '') AS pred, gold_sql AS gold, db_id FROM pairs",
    "write_transcript": f"""SELECT sample_no, 'Sample ' || sample_no || ':' || {_NL} || sample || {_NL} || 'Generated SQL:' || {_NL} ||
            coalesce(answer, '') || {_NL} AS entry FROM
        (SELECT row_number() OVER (ORDER BY v.question_id) AS sample_no,
                {render(T.TASK, question='question', schema='fields')} AS sample, model_predicted_sql AS answer
         FROM valid v LEFT JOIN gen_sql g ON g.question_id = v.question_id AND g.beam = 0 WHERE classification = 'EASY')""",
    "catalog_columns": """SELECT db_id, tab_idx, tname AS table_name, 0 AS col_idx, '*' AS column_name, 'text' AS column_type FROM dbt
        UNION ALL SELECT db_id, tab_idx, tname, col_idx, cname, ctype FROM dbc""",
    "catalog_primary_keys": "SELECT db_id, pk_pos, tname AS table_name, cname AS column_name FROM pks",
    "catalog_foreign_keys": """SELECT db_id, fk_pos, lt AS left_table, rt AS right_table, lc AS left_column, rc AS right_column FROM fks""",
    "catalog_by_db": """SELECT t.db_id, t.tname AS table_name, t.cols AS columns, p.pk AS primary_key, trim(f.foreign_keys, '[]') AS foreign_keys
        FROM (SELECT db_id, tname, string_agg(cname, ',' ORDER BY col_idx) AS cols FROM dbc GROUP BY ALL) t
        LEFT JOIN (SELECT db_id, tname, arg_max(cname, pk_pos) AS pk FROM pks GROUP BY ALL) p ON p.db_id = t.db_id AND p.tname = t.tname
        JOIN fk_text f ON f.db_id = t.db_id""",
    "catalog_rejects": """SELECT db_id, CASE c % 50 WHEN 0 THEN 'primary_key' ELSE 'foreign_key' END AS item,
            CASE c % 50 WHEN 0 THEN '999' WHEN 1 THEN '999,1' ELSE '0,1' END AS detail,
            CASE c % 50 WHEN 2 THEN 'star column' ELSE 'index out of range' END AS reason FROM dbs WHERE c % 50 <= 2""",
    "catalog_summary": """WITH one AS (SELECT db_id, 1::BIGINT AS n_databases,
            (SELECT count(*) FROM dbt WHERE dbt.c = d.c) AS n_tables, (SELECT count(*) FROM dbc WHERE dbc.c = d.c) AS n_columns,
            (SELECT count(*) FROM pks WHERE pks.c = d.c) AS n_primary_keys, (SELECT count(*) FROM fks WHERE fks.c = d.c) AS n_foreign_keys
            FROM dbs d),
        every AS (SELECT * FROM one UNION ALL SELECT NULL, sum(n_databases)::BIGINT, sum(n_tables)::BIGINT, sum(n_columns)::BIGINT,
            sum(n_primary_keys)::BIGINT, sum(n_foreign_keys)::BIGINT FROM one)
        SELECT *, n_columns = 0 AS no_columns, n_primary_keys = 0 AS no_primary_keys, n_foreign_keys = 0 AS no_foreign_keys FROM every""",
    "serialize_fields": "SELECT * FROM fields",
    "serialize_primary_keys": "SELECT * FROM pk_text",
    "serialize_foreign_keys": "SELECT * FROM fk_text",
    "serialize_typed_schema": "SELECT * FROM typed",
    "serialize_linking_schema": "SELECT * FROM linking",
    "serialize_filtered_schema": f"""SELECT t.db_id, t.text || 'foreign keys :' || {_NL} || f.text AS filtered_schema FROM
        (SELECT db_id, string_agg('table ' || shown || ' , columns = [ ' || cols || ' ]' || {_NL}, '' ORDER BY tname) AS text FROM
            (SELECT db_id, tname, shown, string_agg(shown || '.' || cname, ' , ' ORDER BY col_idx) AS cols FROM
                (SELECT *, CASE WHEN length(tname) = 6 THEN tname || ' ( comment : rows of ' || tname || ' )' ELSE tname END AS shown FROM dbc)
             GROUP BY ALL) GROUP BY db_id) t
        JOIN (SELECT db_id, string_agg(lt || '.' || lc || ' = ' || rt || '.' || rc, {_NL} ORDER BY fk_pos) AS text FROM fks GROUP BY db_id) f
        ON t.db_id = f.db_id""",
    "parse_fields": """SELECT db_id, (row_number() OVER (PARTITION BY db_id ORDER BY tname) - 1)::INTEGER AS table_pos, tname AS table_name,
            string_agg(cname, ',' ORDER BY col_idx) AS column_names, 'ok' AS status FROM dbc GROUP BY db_id, tname""",
    "parse_foreign_keys": """SELECT db_id, fk_pos, lt AS left_table, lc AS left_column, rt AS right_table, rc AS right_column FROM fks""",
    "question_schema": "SELECT question_id, q.db_id, question, typed_schema AS schema FROM q JOIN typed ON typed.db_id = q.db_id",
    "questions_without_schema": "SELECT question_id, db_id, question FROM q WHERE db_id NOT IN (SELECT db_id FROM dbs)",
    "baseline_prompt": f"""SELECT question_id, {render(T.BASELINE, question='question', schema='typed_schema')} AS prompt
        FROM q JOIN typed ON typed.db_id = q.db_id""",
    "schema_link_prompt": "SELECT * FROM link_prompts",
    "classification_prompt": f"""SELECT question_id, {render(T.CLASSIFICATION, question='question', schema_links='schema_links')} AS prompt
        FROM q JOIN links USING (question_id)""",
    "sql_prompt": "SELECT question_id, class_norm AS route, fields, foreign_keys, CASE class_norm " + " ".join(
        f"WHEN {lit(k)} THEN {render(t, question='question', schema_links='schema_links', foreign_keys='foreign_keys')}"
        for k, t in (("EASY", T.SQL_EASY), ("NON-NESTED", T.SQL_MEDIUM), ("NESTED", T.SQL_HARD))
    ) + """ END AS prompt FROM q JOIN links USING (question_id) JOIN class_labels USING (question_id)
        JOIN fields ON fields.db_id = q.db_id JOIN fk_text ON fk_text.db_id = q.db_id""",
    "correction_prompt": f"""SELECT question_id, {render(T.CORRECTION, fields='fields', foreign_keys='foreign_keys',
            primary_keys='primary_keys', question='question', reasoning='reasoning', sql='sql')} AS prompt
        FROM q JOIN parsed USING (question_id) JOIN fields ON fields.db_id = q.db_id JOIN fk_text ON fk_text.db_id = q.db_id
        JOIN pk_text ON pk_text.db_id = q.db_id WHERE sql IS NOT NULL""",
    "inference_prompt": f"""SELECT question_id, {render(T.TASK, question='question', schema='schema_links')} AS prompt
        FROM q JOIN links USING (question_id)""",
    "question_shards": "SELECT (question_id % 4)::INTEGER AS shard, count(*) AS n_questions FROM q GROUP BY 1",
    "pending_prompts": "SELECT question_id, prompt_hash, prompt FROM hashed WHERE prompt_hash NOT IN (SELECT prompt_hash FROM completions)",
    "join_completions": """SELECT h.question_id, h.prompt_hash, c.n_attempts, c.attempt, c.status, c.completion FROM hashed h LEFT JOIN
        (SELECT *, count(*) OVER (PARTITION BY prompt_hash) AS n_attempts, row_number() OVER (PARTITION BY prompt_hash ORDER BY attempt DESC) AS r
         FROM completions) c ON c.prompt_hash = h.prompt_hash AND c.r = 1""",
    "extract_schema_links": "SELECT * FROM links",
    "explode_schema_links": "SELECT * FROM link_rows",
    "schema_link_usage": """WITH used AS (SELECT db_id, string_split(item, '.')[1] AS table_name, string_split(item, '.')[2] AS column_name FROM
            (SELECT question_id, left_item AS item FROM link_rows UNION ALL SELECT question_id, right_item FROM link_rows) JOIN q USING (question_id)
            WHERE len(string_split(item, '.')) = 2)
        SELECT db_id, table_name, column_name, 'column' AS level, count(*) AS n_links FROM used GROUP BY ALL
        UNION ALL SELECT db_id, table_name, NULL, 'table', count(*) FROM used GROUP BY ALL""",
    "validate_schema_links": """WITH good AS (SELECT l.question_id, string_agg(l.left_item || coalesce(' = ' || l.right_item, ''), ', ' ORDER BY pos) AS text
            FROM link_rows l JOIN q ON q.question_id = l.question_id
            JOIN dbc a ON a.db_id = q.db_id AND a.tname || '.' || a.cname = l.left_item
            LEFT JOIN dbc b ON b.db_id = q.db_id AND b.tname || '.' || b.cname = l.right_item
            WHERE l.right_item IS NULL OR b.cname IS NOT NULL GROUP BY l.question_id)
        SELECT q.question_id, q.db_id, '[' || coalesce(good.text, '') || ']' AS valid_links FROM q LEFT JOIN good USING (question_id)""",
    "extract_label": "SELECT * FROM class_labels",
    "extract_sub_questions": """SELECT question_id, CASE WHEN contains(response, 'questions = ["')
            THEN string_split(string_split(response, 'questions = ["')[2], '"]')[1] ELSE question END AS sub_questions
        FROM q JOIN class_resp USING (question_id)""",
    "extract_reasoning_sql": "SELECT * FROM parsed",
    "reasoning_steps": r"""WITH cut AS (SELECT question_id, string_split(regexp_replace(reasoning, '(^|\s)([0-9]+[.]\s)', chr(1) || '\2', 'g'), chr(1)) AS a
            FROM parsed WHERE reasoning IS NOT NULL),
        s AS (SELECT question_id, unnest(a) AS s, unnest(range(len(a))) AS i FROM cut),
        b AS (SELECT *, regexp_replace(s, '^[0-9]+[.]\s+', '') AS body FROM s WHERE regexp_matches(s, '^[0-9]+[.]\s+'))
        SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY i) - 1)::INTEGER AS pos,
            regexp_extract(s, '^([0-9]+)[.]', 1)::INTEGER AS step_no,
            CASE WHEN regexp_matches(body, '^[^:]+:') THEN trim(regexp_extract(body, '^([^:]+):', 1)) END AS title,
            trim(CASE WHEN regexp_matches(body, '^[^:]+:') THEN regexp_replace(body, '^[^:]+:', '') ELSE body END) AS step_text FROM b""",
    "nth_sql_block": "SELECT * FROM gen_sql",
    "after_sql_marker": f"""SELECT question_id, trim(replace(string_split(string_split(output, '[SQL]')[-1], '[')[1], {_NL}, ' ')) AS generated_sql FROM
        (SELECT question_id, '[QUESTION]' || question || '[/QUESTION]' || {_NL} || '[SQL]' || {_NL} ||
            replace(query, ' FROM ', {_NL} || 'FROM ') || ' [/SQL] end' AS output FROM q)""",
    "best_beam": "SELECT question_id, beam, output FROM gens WHERE beam = 0",
    "invalid_sql": "SELECT * FROM parsed WHERE sql IS NULL OR sql IN ('', 'SELECT')",
    "classify_gold_sql": "SELECT * FROM gold_class",
    "class_agreement": """SELECT classification, sql_class, count(*) AS n_questions FROM class_labels JOIN gold_class USING (question_id) GROUP BY ALL""",
    "changed_by_correction": """SELECT p.question_id, p.sql AS first_sql, f.sql AS corrected_sql FROM parsed p JOIN fixed f
        ON f.question_id = p.question_id WHERE p.sql IS DISTINCT FROM f.sql""",
    "schema_item_scores": "SELECT * FROM item_score",
    "top_k_tables": _TOP_TABLES,
    "top_k_tables_three": _THREE_TABLES,
    "top_k_columns": _TOP_COLUMNS,
    "filtered_schema": f"""WITH top AS ({_TOP_COLUMNS})
        SELECT t.question_id, t.text || 'foreign keys :' || {_NL} || replace(trim(f.foreign_keys, '[]'), ',', {_NL}) AS filtered_schema FROM
        (SELECT question_id, string_agg('table ' || table_name || ' , columns = [ ' || cols || ' ]' || {_NL}, '' ORDER BY table_rank) AS text FROM
            (SELECT question_id, table_rank, table_name, string_agg(table_name || '.' || column_name, ' , ' ORDER BY column_rank) AS cols
             FROM top GROUP BY ALL) GROUP BY question_id) t
        JOIN q ON q.question_id = t.question_id JOIN fk_text f ON f.db_id = q.db_id""",
    "top_k_tables_external": _EXT_TABLES,
    "top_k_columns_external": _EXT_COLUMNS,
    "valid_samples": "SELECT * FROM valid",
    "samples_by_class": "SELECT * FROM ann WHERE classification = 'EASY'",
    "sft_pairs": "SELECT question_id, text, labels FROM sft WHERE classification = 'EASY'",
    "sft_single_text": "SELECT question_id, text_to_sql FROM single WHERE classification = 'EASY'",
    "train_eval_union": """SELECT question_id, text_to_sql, CASE WHEN question_id % 10 = 0 THEN 'eval' ELSE 'train' END AS split
        FROM single WHERE classification IN ('EASY', 'NON-NESTED')""",
    "token_budget": r"""SELECT question_id, len(a)::INTEGER AS n_tokens, len(a) > 60 AS over_budget, array_to_string(a[1:60], ' ') AS cut_text FROM
        (SELECT question_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS a FROM sft)""",
    "dataset_stats": """SELECT CASE grouping(classification, db_id) WHEN 0 THEN 'class_database' WHEN 1 THEN 'class' ELSE 'total' END AS level,
            classification, db_id, count(*) AS n_rows, count(*) FILTER (score = 1) AS n_valid
        FROM ann LEFT JOIN scores USING (question_id) GROUP BY ROLLUP (classification, db_id)""",
    "attach_predictions": "SELECT question_id, db_id, gold_sql, pred_sql AS model_predicted_sql FROM pairs",
    "exact_match": "SELECT * FROM exact",
    "execution_match": _EXECUTION,
    "annotation_rejects": """SELECT question_id, db_id, concat_ws(', ', CASE WHEN sql IS NULL THEN 'answer without tags' END,
            CASE WHEN db_id NOT IN (SELECT db_id FROM dbs) THEN 'unknown database' END) AS reason
        FROM q JOIN parsed USING (question_id) WHERE sql IS NULL OR db_id NOT IN (SELECT db_id FROM dbs)""",
    "typed_export": """SELECT event_id, user_id, event_type, CASE WHEN event_id % 10 <> 0 THEN trunc(value)::BIGINT END AS value FROM events""",
    "default_missing": f"""SELECT question_id, CASE WHEN question_id % 7 = 0 THEN {lit(T.NO_QUESTION)} ELSE question END AS question,
            {lit(T.NO_SCHEMA)} AS schema_links FROM q""",
    "accuracy_by_class": _accuracy("SELECT question_id, db_id, exact AS ok FROM exact"),
    "accuracy_by_class_clauses": _accuracy(f"""SELECT question_id, db_id, m.ok FROM q
        JOIN (SELECT question_id, min(f1) = 1 AS ok FROM ({_clause_sql()}) GROUP BY question_id) m USING (question_id)"""),
    "accuracy_by_class_execution": _accuracy(f"""SELECT question_id, db_id, r.matches AS ok FROM q
        JOIN ({_EXECUTION}) r ON r.query_id = q.question_id"""),
    "clause_match": _clause_sql(),
    "success_rate": """SELECT count(*) AS n_asked, count(ann.question_id) AS n_generated,
            round(count(ann.question_id) * 100::DOUBLE / count(*), 4) AS success_rate FROM q LEFT JOIN ann ON ann.question_id = q.question_id""",
    "stream_extract": "SELECT * FROM parsed",
    "progress_by_shard": """SELECT (q.question_id % 4)::INTEGER AS shard, count(*) AS n_asked, count(ann.question_id) AS n_processed
        FROM q LEFT JOIN ann ON ann.question_id = q.question_id GROUP BY 1""",
    # relational shapes
    "w_filter_gt": "SELECT p_partkey, p_name FROM part WHERE p_size > 25",
    "w_between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "w_top1_filtered": _top("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'FURNITURE'", 1, "c_acctbal DESC, c_custkey"),
    "w_sum_or": f"SELECT sum(c_acctbal{_D})::DOUBLE AS total_balance FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_mktsegment = 'MACHINERY'",
    "w_like": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'",
    "w_group_top1_sum": _top(f"SELECT p_brand, sum(p_retailprice{_D})::DOUBLE AS total_value FROM part GROUP BY p_brand", 1, "total_value DESC, p_brand"),
    "w_count_distinct": "SELECT count(DISTINCT user_id) AS n_users FROM events WHERE event_type = 'purchase' AND value > 100",
    "w_sort_asc": "SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank FROM customer ORDER BY rank",
    "w_group_top1_count": _top(f"SELECT {_YEAR}::INTEGER AS order_year, count(*) AS n_orders FROM orders GROUP BY 1", 1, "n_orders DESC, order_year"),
    "w_having_avg": f"""SELECT * FROM (SELECT c_nationkey, round({_mean('c_acctbal')}, 4) AS mean_balance FROM customer GROUP BY c_nationkey)
        WHERE mean_balance > 4500""",
    "w_filter_group_count": "SELECT p_brand, count(*) AS n_parts FROM part WHERE p_size > 25 GROUP BY p_brand",
    "w_top3_count": _top("SELECT p_brand, count(*) AS n_parts FROM part GROUP BY p_brand", 3, "n_parts DESC, p_brand"),
    "w_multi_agg": f"SELECT p_type, max(p_retailprice) AS max_price, round({_mean('p_retailprice')}, 4) AS mean_price FROM part GROUP BY p_type",
    "w_having_distinct": "SELECT p_name, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1",
    "w_top1": _top("SELECT o_orderkey, o_totalprice FROM orders", 1, "o_totalprice DESC, o_orderkey"),
    "w_gt_scalar_avg": f"SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT {_mean('c_acctbal')} FROM customer)",
    "w_join_two_distinct": """SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT s_suppkey) AS n_suppliers
        FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
    "w_join_having_eq": """SELECT o_orderkey, o_totalprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY o_orderkey, o_totalprice HAVING count(l_orderkey) = 2""",
    "w_join_distinct_or": f"SELECT DISTINCT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE {_YEAR} = 1997 OR {_YEAR} = 1998",
    "w_join3_sorted": f"""SELECT c_name, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER
            (ORDER BY c_name, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE {_YEAR} = 1998 ORDER BY rank""",
    "w_join_having_gt": """SELECT c_custkey, c_name, c_nationkey, c_mktsegment, count(o_orderkey) AS n_orders
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING count(o_orderkey) > 1""",
    "w_not_in_self": """SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id NOT IN
        (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)""",
    "w_not_in_other": """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
        (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
    "w_distinct_lt_max": "SELECT DISTINCT p_retailprice FROM part WHERE p_retailprice < (SELECT max(p_retailprice) FROM part)",
    "w_join_filter": """SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE year(l_shipdate) = 1999 AND l_returnflag = 'A' AND o_orderstatus = 'F'""",
    "w_having_scalar": f"""SELECT c_nationkey, min(c_acctbal) AS min_balance FROM customer GROUP BY c_nationkey
        HAVING {_mean('c_acctbal')} > (SELECT {_mean('c_acctbal')} FROM customer)""",
    "w_join_scalar_eq": """SELECT l_orderkey, l_linenumber, l_quantity, p_name FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE l_partkey = (SELECT min(p_partkey) FROM part WHERE p_name = 'small ring')""",
    "w_join3_composite": """SELECT o_orderkey, c_name, customer.c_nationkey, customer.c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN (SELECT c_nationkey, c_mktsegment, max(c_acctbal) AS peak FROM customer GROUP BY ALL) p
        ON p.c_nationkey = customer.c_nationkey AND p.c_mktsegment = customer.c_mktsegment
        WHERE p.peak = (SELECT max(c_acctbal) FROM customer)""",
    "w_intersect": "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'",
    "w_except": """SELECT user_id FROM events WHERE event_type = 'click' EXCEPT
        SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100""",
    "w_union": "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
    "w_count_star_filter": "SELECT count(*) AS n_events FROM events WHERE value > 100",
    "w_group_join_top1": _top("""SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""", 1, "n_orders DESC, n_name"),
    "w_never": f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_YEAR} = 1997)",
    "w_impossible_range": """SELECT o_orderstatus FROM orders WHERE o_totalprice > 400000 INTERSECT
        SELECT o_orderstatus FROM orders WHERE o_totalprice < 100000""",
}


def _mentions(text: str) -> list[str]:
    """Sub-queries the text names, in definition order, with their own needs."""
    import re

    needed: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"[A-Za-z_]+", todo.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    return [n for n in CTES if n in needed]


# Other ways to the same rows: stored, published or counted by batch.
SAME_ROWS = {
    "commit_annotations": "write_annotations",
    "pending_prompts_stored": "pending_prompts",
    "join_completions_stored": "join_completions",
    "progress_by_batch": "progress_by_shard",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in [*STATEMENTS.items(), *((n, STATEMENTS[like]) for n, like in SAME_ROWS.items())]:
        ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in _mentions(body))
        out[name] = f"WITH {ctes} SELECT * FROM ({body})" if ctes else body
    return out
