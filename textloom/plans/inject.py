"""Deterministic artifacts in the sample tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread

_N = "chr(10)"
_CASES = [
    "text",
    "replace(text, ' the ', ' — the ')",
    "replace(text, ' of ', ' utilize ')",
    f"concat('Certainly! ', text, {_N}, 'I hope this helps!')",
    "replace(text, '. ', '… ')",
    "replace(replace(text, ' de ', ' de '), ' on ', ' on ')",
    "replace(text, ' and ', ' \U0001f680✓→• ')",
    f"concat(text, {_N}, {_N}, 'Surely so. It is worth noting that we utilize robust ideas. Please note that it ends', {_N}, 'Ultimately, ok')",
    "concat('“', replace(text, ' in ', ' – '), '” ‘x’')",
    "replace(text, ' to ', ' zero​width soft­hyphen ')",
    f"concat('I''d be happy to, so: ', text, {_N}, {_N}, 'Happy to help! Feel free to ask. Don''t hesitate to reach out')",
    f"concat('In summary, ', text, {_N}, ' At the end of the day, all. All in all fine', {_N})",
    f"concat('utilized leverages Utilizes. ', text, {_N}, 'UTILIZE Leverage implement; STATE-OF-THE-ART')",
    "concat('please note that additional METHODOLOGY and Regarding cutting-edge. ', replace(text, ' is ', ' —…— '))",
    f"concat(text, {_N}, 'Keep in mind that', {_N}, {_N}, 'Of course!', {_N}, 'Definitely—yes')",
    "replace(replace(text, ' a ', ' holistic — '), ', ', ' note that ')",
]
_L = lambda *lines: "concat(" + ", ".join(f"'{x}', {_N}" if x else _N for x in (y.replace("'", "''") for y in lines)) + ")"
_SNIPPETS = {
    "rs": _L("//! This module contains the parser.", "/// Returns the value.", "fn value() -> u32 { 1 }", "", "// Initialize the user list", "let mut userList = initialize_users();", "// note that this holds — always", "", "", "// Use a tree here", "let x = 1;"),
    "py": _L("# Initialize", "x = 1", "", "def f(a):", '    """', "    This function does the work", '    """', "    # Set a value", "    value = a", '    """', "    Args:", "        data: The input data.", "    Returns:", "        The output data.", '    """', "    Args:", "    Returns:", "    # we utilize robust code", "    return value"),
    "js": _L("/**", " * This function does it", " */", "function f() {}", "/**", " * @param data The data.", " */", "console.log('testing');", "  console.log(\"here\")", "// leverage the list", "const list = 1; // seamlessly"),
    "go": _L("// Server handles the Request", "func Server() {}", "// Count the items", "items := count(items)", "/* keep in mind that it waits */"),
    "sql": _L("-- Select all users", "SELECT * FROM users", "-- -----", "-- it should be noted that rows", "SELECT 1;"),
    "json": _L('{"a": "utilize — “b”"}'),
    "md": _L("# Title", "Certainly! We utilize it.", "", "I hope this helps."),
    "tex": _L("% note that …", "Text \\section{utilize}"),
}
_EXTS = list(_SNIPPETS)
_EXT = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTS)) + " END"
#: What each line of the document's own text begins with behind the snippet: it becomes comments where there are any.
_LEADS = {"rs": "// ", "py": "# ", "js": "// ", "go": "// ", "sql": "-- ", "json": "", "md": "", "tex": "% "}
_WHOLE = lambda e: f"concat({_SNIPPETS[e]}, '{_LEADS[e]}', replace(text, {_N}, concat({_N}, '{_LEADS[e]}')), {_N})" if _LEADS[e] else f"concat({_SNIPPETS[e]}, text, {_N})"
_CODE = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {_WHOLE(e)}" for i, e in enumerate(_EXTS)) + " END"
_PROSE = "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CASES)) + " END"
#: View -> expressions of path, ext and content.
VIEWS = {
    "prose": ("concat('docs/', cast(doc_id AS string), '.md')", "'md'", _PROSE),
    "tree": ("concat('docs/', lang, '/', source, '/', cast(doc_id AS string), '.md')", "'md'", _PROSE),
    "turns": ("concat('c/', cast(conv_id AS string), '-', role, '.md')", "'md'", _PROSE),
    "code": (f"concat('src/', cast(doc_id AS string), '.', {_EXT})", _EXT, _CODE),
}


#: Turns of ``conversations`` as documents: a number for each, and the same artifacts by it.
TURNS = "conv_id * 1000 + turn"


def duckdb_sql(name: str) -> str:
    path, ext, content = VIEWS[name]
    source, more = ("documents", "") if name != "turns" else (f"(SELECT *, {TURNS} AS doc_id FROM conversations)", ", conv_id, turn, role")
    return f"SELECT doc_id, {path.replace('string', 'varchar')} AS path, {ext} AS ext, {content} AS content{more} FROM {source}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """doc_id, path, ext, content of the ``prose``, ``code`` or ``tree`` view of ``documents``, or of ``turns``, which
    also has conv_id, turn and role."""
    path, ext, content = (F.expr(e.replace("''", "\\'").replace("\\section", "\\\\section")) for e in VIEWS[name])
    if name == "turns":
        rows, more = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("doc_id", F.expr(TURNS)), ["conv_id", "turn", "role"]
    else:
        rows, more = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *(("lang", "source") if name == "tree" else ()))), []
    return rows.select(*more, "doc_id", path.alias("path"), ext.alias("ext"), content.alias("content"))
