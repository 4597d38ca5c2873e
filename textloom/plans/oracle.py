"""The registered queries once more, as DuckDB SQL built from the same rule table."""

from __future__ import annotations

from ..operators import comments as c
from . import rules as r
from .inject import duckdb_sql
from .rules import Rule, Settings

NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(xs) -> str:
    return ", ".join(map(lit, xs))


def pattern(flags: str, body: str) -> str:
    return lit((f"(?{flags})" if flags else "") + body)


def hits(source: str, p: str, extra: str = "") -> str:
    """doc_id, seq, s, e, original of every match in ``content`` of ``source``."""
    return f"""SELECT doc_id{extra}, i AS seq, s, s + length(h[i]) AS e, h[i] AS original FROM (
      SELECT *, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM (
        SELECT doc_id{extra}, h, g, unnest(range(1, len(h) + 1)) AS i FROM (
          SELECT doc_id{extra}, regexp_extract_all(content, {p}) AS h, regexp_split_to_array(content, {p}) AS g FROM {source} WHERE regexp_matches(content, {p}))))"""


def stripped(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A[\s\x{{00A0}}]+', ''), '[\s\x{{00A0}}]+\z', '')"


def _row(reg: int, rule: Rule, inner: str, suggestion: str | None = None, kind: str | None = None, conf: str | None = None, desc: str | None = None, original: str = "original") -> str:
    return (
        f"SELECT doc_id, {reg} AS reg, seq, s, e, {lit(rule.id)} AS rule_id, {lit(rule.category)} AS category, {lit(rule.severity)} AS severity, {conf or rule.confidence}::DOUBLE AS confidence, "
        f"{original} AS original, {suggestion or lit(rule.value)} AS suggestion, {kind or lit(rule.kind)} AS kind, {desc or lit(rule.description)} AS description FROM ({inner})"
    )


def _trivial(source: str) -> str:
    comment = r"'^\s*(?://|#|--|%)'"
    return rf"""SELECT doc_id, i AS seq, s, least(s + n + 1, total) AS e, line AS original, len(w) AS nw, len(list_filter(w, lambda t: list_contains(code, t))) AS nc FROM (
      SELECT *, list_filter(list_filter(regexp_split_to_array(lower(regexp_replace(line, {comment}, '')), '[\s!-/:-@\[-`{{-~]+'), lambda t: t <> ''), lambda t: NOT list_contains([{names(c.STOP_WORDS)}], t)) AS w,
        list_filter(regexp_split_to_array(lower(regexp_replace(near, '([a-z])([A-Z])', '\1 \2', 'g')), '[\s!-/:-@\[-`{{-~]+'), lambda t: t <> '') AS code FROM (
        SELECT *, coalesce(first_value(CASE WHEN is_code THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
            last_value(CASE WHEN is_code THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS near,
          coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (
          SELECT *, length(line) AS n, NOT regexp_matches(line, {comment}) AND regexp_matches(line, '\S') AS is_code FROM (
            SELECT doc_id, length(content) AS total, unnest(string_split(content, {NL})) AS line, generate_subscripts(string_split(content, {NL}), 1) AS i FROM {source})))
      WHERE near IS NOT NULL AND regexp_matches(line, {comment}) AND NOT regexp_matches(line, '^\s*//[/!]'))
    WHERE 5 * nc >= 4 * nw"""


def rule_sql(reg: int, rule: Rule, source: str = "v", code: str = f"ext IN ({names(c.CODE)})") -> str:
    """The rule's matches before gates and widening; ``code`` tells files of code."""
    if rule.code_only:
        source = f"(SELECT * FROM {source} WHERE {code})"
    if rule.id == "trivial-comment":
        return _row(reg, rule, _trivial(source), conf="CASE WHEN nc = nw THEN 0.85 ELSE 0.7 END", desc="CASE WHEN nw = 0 THEN 'Trivial comment (stop words only).' ELSE 'Trivial comment restates code.' END")
    if rule.id == "docstring-filler":
        generic = pattern("im", c.GENERIC.partition(")")[2])
        parts = []
        for k, (p, inner) in enumerate(((("s", c.QUOTED), "trim(original, '\"''')"), (("sm", r"^(?:[ \t]*///.*(?:\n|$))+"), "replace(original, '///', '')"), (("sm", r"^[ \t]*/\*\*.*?\*/"), r"regexp_replace(original, '/\*\*|\*/|\*', '', 'g')"))):
            parts.append(f"SELECT doc_id, {k} * 1000 + seq AS seq, s, e, original FROM ({hits(source, pattern(*p))}) WHERE regexp_matches({stripped(inner)}, {generic})")
        return _row(reg, rule, " UNION ALL ".join(parts))
    if rule.id == "python-args-boilerplate":
        a, b = hits(source, pattern(*r.PY_ARGS)), hits(source, pattern(*r.PY_RETURNS))
        inner = f"SELECT *, 'Args section contains only generic boilerplate with no real semantic information.' AS what FROM ({a}) UNION ALL SELECT b.doc_id, 1000 + b.seq, b.s, b.e, b.original, 'Returns section contains only generic boilerplate.' FROM ({b}) b WHERE NOT EXISTS (SELECT 1 FROM ({a}) a WHERE a.doc_id = b.doc_id AND a.s <= b.s AND a.e >= b.e)"
        return _row(reg, rule, inner, desc="'Python docstring ' || what", original="left(original, 80) || '…'")
    if rule.id == "python-empty-docstring-section":
        inner = f"SELECT doc_id, seq, s, s + length(part) AS e, {stripped('part')} AS original FROM (SELECT *, regexp_extract(original, {pattern(*r.PY_EMPTY)}, 1) AS part FROM ({hits(source, pattern(*r.PY_EMPTY))}))"
        return _row(reg, rule, inner)
    if rule.id == "sql-verbose-doc":
        inner = f"SELECT doc_id, seq, s, s + length(part) AS e, {stripped('part')} AS original FROM (SELECT *, string_split(original, {NL})[1] AS part FROM ({hits(source, pattern(*r.SQL_DOC))}))"
        return _row(reg, rule, inner)
    inner = " UNION ALL ".join(f"SELECT doc_id, {k} * 1000000 + seq AS seq, s, e, original FROM ({hits(source, pattern(*p))})" for k, p in enumerate(rule.patterns))
    if rule.patterns[0][1].startswith("(?!["):  # symbols but the allowed ones: RE2 has no lookahead
        symbols, kept = rule.patterns[0][1].partition("])")[2], rule.patterns[0][1][4:].partition("])")[0]
        inner = f"SELECT * FROM ({hits(source, pattern('', symbols))}) WHERE original NOT IN ({names(kept.replace(chr(92), ''))})"
    if rule.id == "curly-quotes":
        return _row(reg, rule, inner, suggestion="CASE WHEN original IN ('“', '”') THEN '\"' ELSE '''' END")
    if rule.id == "hollow-intensifiers":
        syn = "CASE lower(original) " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in r.SYNONYMS.items()) + " END"
        cased = "CASE WHEN syn IS NULL THEN '' WHEN original = upper(original) THEN upper(syn) WHEN left(original, 1) = upper(left(original, 1)) THEN upper(left(syn, 1)) || substring(syn, 2) ELSE syn END"
        return _row(reg, rule, f"SELECT *, {syn} AS syn FROM ({inner})", suggestion=cased, kind="CASE WHEN syn IS NULL THEN 'FlagOnly' ELSE 'Replace' END", desc="CASE WHEN syn IS NULL THEN 'Hollow intensifier. Rephrase to be more direct.' ELSE 'Hollow intensifier. Use ''' || syn || ''' instead.' END")
    if rule.captures:
        out = lit(rule.value)
        for i in range(9, 0, -1):
            if f"${i}" in rule.value:
                out = f"replace({out}, '${i}', regexp_extract(original, {pattern(*rule.patterns[0])}, {i}))"
        return _row(reg, rule, inner, suggestion=out)
    return _row(reg, rule, inner)


def ctes(view: str, settings: Settings, upto: str) -> str:
    """WITH clause: v, spans, m (gated and widened), and as asked resolved and cleaned."""
    active = [(i, x) for i, x in settings.rules() if x.confidence >= settings.min_confidence or x.id == "trivial-comment"]
    spans = " UNION ALL ".join(f"SELECT doc_id, s, e FROM ({hits(f'(SELECT * FROM v WHERE ext IN ({names(exts)}))', pattern(*p))})" for exts, ps in c.COMMENT_PATTERNS for p in ps)
    code = f"ext IN ({names(c.CODE)})" if settings.lang not in (*c.CODE, *c.PROSE) else str(settings.lang in c.CODE).lower()
    found = " UNION ALL ".join(rule_sql(i, x, code=code) for i, x in active)
    out = f"""WITH v AS ({duckdb_sql(view)}),
    raw_spans AS ({spans}),
    marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM raw_spans),
    spans AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY doc_id, g)"""
    if upto == "spans":
        return out
    deletes = "kind IN ('DeleteLine', 'DeleteBlock')"
    out += f""",
    found AS ({found}),
    gated AS (SELECT f.*, content, path FROM found f JOIN v USING (doc_id) WHERE confidence >= {settings.min_confidence} AND (NOT {code} OR category <> 'prose'
      OR EXISTS (SELECT 1 FROM spans x WHERE x.doc_id = f.doc_id AND x.s <= f.s AND x.e >= f.e))),
    ended AS (SELECT *, CASE WHEN substring(content, e, 1) = {NL} THEN e - 1 ELSE e END AS e0 FROM gated),
    m AS (SELECT * EXCLUDE (s, e, e0), CASE WHEN {deletes} THEN s - length(string_split(substring(content, 1, s), {NL})[-1]) ELSE s END AS s,
      CASE WHEN NOT {deletes} THEN e WHEN strpos(substring(content, e0 + 1), {NL}) > 0 THEN e0 + strpos(substring(content, e0 + 1), {NL}) ELSE length(content) END AS e FROM ended)"""
    if upto == "m":
        return out
    out += """,
    chained AS (SELECT *, CASE WHEN s < max(e) OVER w THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY s, reg, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    resolved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY reg, s, seq) AS k FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, reg, seq ROWS UNBOUNDED PRECEDING) AS g FROM chained)) WHERE k = 1),
    scored AS (SELECT v.*, coalesce(n, 0) AS n, CASE WHEN length(content) > 0 THEN 1000.0 * coalesce(n, 0) / length(content) ELSE 0.0 END::DOUBLE AS density FROM v LEFT JOIN (SELECT doc_id, count(*) AS n FROM resolved GROUP BY doc_id) USING (doc_id))"""
    if upto == "resolved":
        return out
    return out + rf""",
    pieces AS (SELECT doc_id, string_agg(substring(content, prev + 1, s - prev) || CASE WHEN kind = 'Replace' THEN suggestion ELSE '' END, '' ORDER BY s, reg) AS body, max(e) AS last, bool_or({deletes}) AS deleted FROM (
      SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, reg), 0) AS prev FROM resolved WHERE kind <> 'FlagOnly') GROUP BY doc_id),
    spliced AS (SELECT v.doc_id, v.path, v.content, coalesce(deleted, false) AS deleted, coalesce(body || substring(content, last + 1), content) AS t FROM v LEFT JOIN pieces USING (doc_id)),
    cleaned AS (SELECT doc_id, path, content, CASE WHEN deleted AND contains(t, {NL} || {NL} || {NL}) THEN regexp_replace(regexp_replace(t, '\n(?:[ \t\r]*\n)+', {NL} || {NL}, 'g'), '\n+\z', {NL}) ELSE t END AS cleaned FROM spliced)"""


def _at(end: str) -> tuple[str, str]:
    """0-based line and UTF-16 column of a place."""
    before = f"substring(content, 1, {end})"
    last = f"string_split({before}, {NL})[-1]"
    astral = rf"length(regexp_replace({last}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"
    return f"(length({before}) - length(replace({before}, {NL}, '')))::INTEGER", f"(length({last}) + {astral})::INTEGER"


def diagnostics_sql(view: str, settings: Settings) -> str:
    (a, b), (x, y) = _at("s"), _at("e")
    severity = "CASE WHEN kind <> 'FlagOnly' AND confidence >= 0.85 THEN 'Error' ELSE 'Warning' END"
    return f"""{ctes(view, settings, "resolved")}, diagnostic AS (SELECT doc_id, {a} AS start_line, {b} AS start_character, {x} AS end_line, {y} AS end_character,
      {severity} AS severity, rule_id, kind, suggestion AS new_text FROM resolved)"""


def accepted_sql(view: str, settings: Settings) -> str:
    """Matches at even offsets are accepted, hedges with an edit."""
    sql = ctes(view, settings, "cleaned").replace("FROM resolved WHERE kind <> 'FlagOnly'", "FROM accepted WHERE kind <> 'FlagOnly'")
    one = """accepted AS (SELECT * REPLACE (CASE WHEN rule_id = 'hedges' THEN 'Replace' ELSE kind END AS kind, CASE WHEN rule_id = 'hedges' THEN 'NB: ' ELSE suggestion END AS suggestion) FROM resolved WHERE s % 2 = 0),
    pieces AS ("""
    return sql.replace("pieces AS (", one, 1) + " SELECT doc_id, coalesce(n, 0)::BIGINT AS accepted, cleaned FROM cleaned LEFT JOIN (SELECT doc_id, count(*) AS n FROM accepted GROUP BY doc_id) USING (doc_id)"


# The rules in order of priority by category, and the categories of the profiles.
PROFILE_SQL = """WITH rule(n, rule_id, category) AS (VALUES
  (1, 'em-dash', 'typographic'), (2, 'en-dash', 'typographic'), (3, 'curly-quotes', 'typographic'), (4, 'ellipsis', 'typographic'), (5, 'nbsp', 'typographic'),
  (6, 'zero-width', 'typographic'), (7, 'soft-hyphen', 'typographic'), (8, 'emoji', 'symbol'), (9, 'decorative-unicode', 'symbol'), (10, 'filler-openers', 'prose'),
  (11, 'sycophantic-closers', 'prose'), (12, 'hedges', 'prose'), (13, 'transition-padding', 'prose'), (14, 'hollow-intensifiers', 'prose'), (15, 'trivial-comment', 'code'),
  (16, 'docstring-filler', 'code'), (17, 'rust-verbose-doc', 'pack'), (18, 'rust-trivial-mod-doc', 'pack'), (19, 'python-args-boilerplate', 'pack'),
  (20, 'python-empty-docstring-section', 'pack'), (21, 'jsts-boilerplate', 'pack'), (22, 'jsts-console-log', 'pack'), (23, 'go-verbose-doc', 'pack'), (24, 'sql-verbose-doc', 'pack')),
profile(profile, more) AS (VALUES ('conservative', ''), ('prose', 'prose'), ('code', 'code'), ('aggressive', 'prose code'),
  ('rust-pack', 'code pack'), ('python-pack', 'code pack'), ('jsts-pack', 'code pack'), ('go-pack', 'code pack'), ('sql-pack', 'code pack'))
SELECT profile, (row_number() OVER (PARTITION BY profile ORDER BY n) - 1)::INTEGER AS priority, rule_id
FROM profile JOIN rule ON category IN ('typographic', 'symbol') OR list_contains(string_split(more, ' '), category)"""

LINE = f"(1 + length(substring(content, 1, s)) - length(replace(substring(content, 1, s), {NL}, '')))::INTEGER"
COL = f"(1 + length(string_split(substring(content, 1, s), {NL})[-1]))::INTEGER"


def match_sql(view: str, settings: Settings, upto: str = "resolved") -> str:
    return f"""{ctes(view, settings, upto)}
    SELECT doc_id, path, rule_id, category, severity, confidence, s::INTEGER AS span_start, e::INTEGER AS span_end, {LINE} AS line, {COL} AS col, original, suggestion, kind, description FROM {upto}"""
