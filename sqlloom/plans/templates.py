"""Prompt templates.  ``{slot}`` marks a column that is filled in.

Fixed values, read back by the extractors: the tags ``<chains>``, ``<REASONING>``, ``<SQL>`` and ``[SQL]``, the line
head ``Schema Links:`` and the mark ``Label: "``.
"""

BASELINE = """\
These tables and columns are available:
{schema}

A user asks: {question}
Reply with a single SQL query over them and nothing else. It starts after this mark.
[SQL]
"""

SCHEMA_LINK = """\
Name the tables and columns of the schema that a query for the question needs.

An example of the expected line:
Schema Links: [invoice.total, invoice.client_id = client.id]

{schema_text}
{fk_text}

Question: "{question}"

Use only names from the schema, add the key pairs that connect the tables, and leave out everything else.
Finish with one plain line: Schema Links: [table.column, table.column = table.column]
"""

CLASSIFICATION = """\
Decide whether the question needs an EASY (one table), NON-NESTED (join) or NESTED (sub-query or set operation) query.

Q: "How many invoices are open?"
schema_links: [invoice.state]
A: One table and no inner query. questions = [""]
Label: "EASY"

Q: "{question}"
schema_links: {schema_links}
A: Step by step:"""

_REASON = """\
Give the reasoning as numbered steps (Sequential, Condition, Join and Aggregation Structure) between <chains> and
</chains>, then the query between <SQL> and </SQL>.
"""

_SQL_SLOTS = """
# Question
Question: "{question}"

# Links
Schema_links: {schema_links}

# Keys
Foreign_keys = {foreign_keys}
"""

SQL_EASY = "Answer with a query over a single table.\n" + _REASON + _SQL_SLOTS
SQL_MEDIUM = "Answer with a query that joins tables along their keys.\n" + _REASON + _SQL_SLOTS
SQL_HARD = "Answer with a query that may use sub-queries or set operations.\n" + _REASON + _SQL_SLOTS

CORRECTION = """\
A draft query follows, with the thoughts that led to it. Say what is wrong with it, if anything, between <REASONING> and
</REASONING>, and give the final query between <SQL> and </SQL>.

Draft: {sql}
Thoughts: {reasoning}
It should answer: {question}

The database:
{fields}Keys of the tables: {primary_keys}
Links between the tables: {foreign_keys}
"""

TASK = """\
You write SQL. Give numbered reasoning between <chains> and </chains> and the query between <SQL> and </SQL>.

# Question
{question}

# Schema
{schema}
"""

TARGET = """
<chains>
{reasoning}
</chains>
<SQL>
{sql}
</SQL>
"""

SINGLE_TEXT = TASK + TARGET

# The texts that stand for a missing slot.
NO_QUESTION = "No question provided"
NO_SCHEMA = "No schema provided"
