"""The same results as plain SQL for DuckDB, stated independently of the Spark plans."""

from __future__ import annotations

from lexfit import fixed_values as fx
from lexfit.plans import workload as w

WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SQL: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- building blocks ------------------------------------------------------------
def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean(x: str) -> str:
    out = rf"replace(regexp_replace({x}, '[!-/:-@\[-`{{-~]', ' ', 'g'), chr(10), '')"
    out = rf"regexp_replace({out}, '[^{WORD}{SPACE}]', '', 'g')"
    for letter, pair in fx.UMLAUTS.items():
        out = f"replace({out}, '{letter}', '{pair}')"
    return f"lower({out})"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda t: t <> '')"


def token_text(x: str) -> str:
    return f"array_to_string({tokens(clean(x))}, ' ')"


def word_list(words: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in words) + "]"


def fill(template: str, **fields: str) -> str:
    out = q(template)
    for name, value in fields.items():
        out = f"replace({out}, '{{{name}}}', coalesce({value}, ''))"
    return out


def file_name(*fields: str, prefix: str = "") -> str:
    joined = " || '_' || ".join(f"coalesce({f}, '')" for f in fields)
    forbidden = r"""'[/:<>*?"\\|]'"""
    return f"regexp_replace({q(prefix)} || {joined}, {forbidden}, '_', 'g')"


def parts(html: str, tag: str) -> str:
    """Headings and texts without tags, each part treated by itself."""
    text = rf"trim(regexp_replace(regexp_replace(p, '<[^<]+?>', ' ', 'g'), '[{SPACE}]+', ' ', 'g'))"
    return f"list_filter(list_transform({raw_parts(html, tag)}, lambda p: {text}), lambda p: p <> '')"


def raw_parts(html: str, tag: str) -> str:
    marked = rf"regexp_replace({html}, '(<{tag}.*?>.*?</{tag}>)', chr(1) || '\1' || chr(1), 'g')"
    return f"string_split({marked}, chr(1))"


def between(html: str, markers: tuple[str, str]) -> str:
    return f"regexp_split_to_array({html}, {q('|'.join(markers))})[2]"


def group1(html: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({html}, {q(pattern)}) THEN regexp_extract({html}, {q(pattern)}, 1) END"


def address_items(x: str) -> str:
    return f"list_transform(string_split({x}, ','), lambda s: {strip('s')})[:-2]"


def facts(html: str) -> str:
    words = f"string_split(regexp_replace({html}, '<[^<]+?>', '', 'g'), ' ')"
    for prefix in w.DROP_PREFIXES:
        words = f"list_filter({words}, lambda t: NOT starts_with(t, {q(prefix)}))"
    first = ", ".join(f"nullif(list_position(ws, {q(x)}), 0)" for x in w.SIZE_WORDS)
    cut = f"(SELECT ws[:coalesce({first}, len(ws) + 1) - 1] FROM (SELECT {words} AS ws))"
    items = f"list_transform(string_split(array_to_string({cut}, ' '), ','), lambda s: {strip('s')})"
    return f"list_filter({items}, lambda s: s <> '')"


def keyword(keywords: list[str]) -> str:
    return rf"(?i)(^|[^{WORD}])(?:{'|'.join(keywords)})($|[^{WORD}])"


TERM_ROWS = ", ".join(
    f"({q(s)}, {i}, {q(t)})" for s, words in w.TERMS.items() for i, t in enumerate(words)
)

# Stems of the tokens in a CTE vocab(token): one row per token.
V = "aeiouyäöü"
REGION = f"^[^{V}]*[{V}]+[^{V}]"


def ends(word: str, suffix: str, start: str) -> str:
    return f"(ends_with({word}, '{suffix}') AND length({word}) - {len(suffix)} >= {start})"


def pick(word: str, suffixes: list[str], start: str) -> str:
    cases = " ".join(f"WHEN {ends(word, s, start)} THEN '{s}'" for s in suffixes)
    return f"CASE {cases} ELSE '' END"


def cut(word: str, n: str) -> str:
    return f"left({word}, length({word}) - {n})"


STEMS = rf"""
sb0 AS (SELECT token, replace(lower(token), 'ß', 'ss') AS w FROM vocab),
sb1 AS (SELECT token, CASE WHEN regexp_matches(w, '[{V}][uy][{V}]') THEN list_reduce(
          list_transform(range(1, length(w) + 1), lambda i: substr(w, i::BIGINT, 2)),
          lambda acc, x: acc || CASE WHEN x[1:1] IN ('u', 'y') AND regexp_matches(acc, '[{V}]$')
            AND regexp_matches(x, '^.[{V}]') THEN upper(x[1:1]) ELSE x[1:1] END, '')
        ELSE w END AS w FROM sb0),
sb2 AS (SELECT token, w, length(regexp_extract(w, '{REGION}')) AS p1 FROM sb1),
sb3 AS (SELECT *, length(regexp_extract(substr(w, p1 + 1), '{REGION}')) AS p2 FROM sb2),
sb4 AS (SELECT token, w, CASE WHEN p1 = 0 THEN length(w) + 9 WHEN p1 < 3 THEN 3 ELSE p1 END AS a,
          CASE WHEN p1 = 0 OR p2 = 0 THEN length(w) + 9 ELSE p1 + p2 END AS b FROM sb3),
sb5 AS (SELECT *, {pick("w", ["ern", "em", "er", "en", "es", "e", "s"], "a")} AS s FROM sb4),
sb6 AS (SELECT token, a, b, CASE
          WHEN s IN ('en', 'es', 'e') AND ends_with({cut("w", "length(s)")}, 'niss') THEN {cut("w", "length(s) - 1")}
          WHEN s = 's' AND NOT regexp_matches(w, '[bdfghklmnrt]s$') THEN w
          ELSE {cut("w", "length(s)")} END AS w FROM sb5),
sb7 AS (SELECT *, {pick("w", ["est", "en", "er", "st"], "a")} AS s FROM sb6),
sb8 AS (SELECT token, b, CASE
          WHEN s = 'st' AND NOT regexp_matches(w, '...[bdfghklmnt]st$') THEN w
          ELSE {cut("w", "length(s)")} END AS w FROM sb7),
sb9 AS (SELECT *, {pick("w", ["isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"], "b")} AS s FROM sb8),
sb10 AS (SELECT *, {cut("w", "length(s)")} AS stem, substr({cut("w", "length(s)")}, b + 1) AS r2 FROM sb9),
sb11 AS (SELECT token, CASE
          WHEN s = '' THEN w
          WHEN s IN ('end', 'ung') THEN
            CASE WHEN ends_with(r2, 'ig') AND NOT ends_with(r2, 'eig') THEN {cut("stem", "2")} ELSE stem END
          WHEN s IN ('isch', 'ig', 'ik') THEN CASE WHEN ends_with(r2, 'e') THEN w ELSE stem END
          WHEN s IN ('lich', 'heit') THEN
            CASE WHEN ends_with(r2, 'er') OR ends_with(r2, 'en') THEN {cut("stem", "2")} ELSE stem END
          WHEN ends_with(r2, 'lich') THEN {cut("stem", "4")}
          WHEN ends_with(r2, 'ig') THEN {cut("stem", "2")} ELSE stem END AS w FROM sb10),
snow AS (SELECT token, translate(w, 'äöüUY', 'aouuy') AS stem1 FROM sb11),
ci0 AS (SELECT token, stem1, regexp_replace(replace(translate(lower(stem1), 'äöü', 'aou'), 'ß', 'ss'),
          '^ge(.{{4,}})', '\1') AS w FROM snow),
ci1 AS (SELECT token, stem1, list_reduce(
          string_split(replace(replace(replace(w, 'sch', '$'), 'ei', '%'), 'ie', '&'), ''),
          lambda acc, c: acc || CASE WHEN right(acc, 1) = c THEN '*' ELSE c END, '') AS w FROM ci0),
ci2 AS (
  SELECT token, stem1, w FROM ci1
  UNION ALL
  SELECT token, stem1, CASE WHEN length(w) > 5 AND regexp_matches(w, '(e[mr]|nd)$') THEN {cut("w", "2")}
    ELSE {cut("w", "1")} END FROM ci2
  WHERE (length(w) > 5 AND regexp_matches(w, '(e[mr]|nd)$')) OR (length(w) > 3 AND regexp_matches(w, '[tesn]$'))),
ci3 AS (SELECT token, stem1, arg_min(w, length(w)) AS w FROM ci2 GROUP BY token, stem1),
stems AS (SELECT token, stem1, replace(replace(replace(
          regexp_replace(w, '(.)\*', '\1\1', 'g'), '&', 'ie'), '%', 'ei'), '$', 'sch') AS stem2 FROM ci3)"""

DOC_TOKENS = f"""
doc_tokens AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
  FROM (SELECT doc_id, {tokens(clean("text"))} AS t FROM documents))"""
VOCAB = "vocab AS (SELECT DISTINCT token FROM doc_tokens)"

# Scores of (id, section, text) rows in a CTE texts against terms(section, pos, term).
TERMS = f"""
terms AS (SELECT section, pos, {tokens(clean("term"))}[1] AS term
  FROM (VALUES {TERM_ROWS}) AS v(section, pos, term) WHERE len({tokens(clean("term"))}) > 0)"""


def scores(doc_texts: str) -> str:
    return rf"""
texts AS ({doc_texts}),
tf AS (SELECT id, section, token, count(*) AS tf FROM (
    SELECT id, section, unnest(regexp_extract_all(lower(text), '[{WORD}]{{2,}}')) AS token FROM texts)
  GROUP BY ALL),
qf AS (SELECT section, term AS token, count(*) AS qf FROM terms WHERE length(term) > 1 GROUP BY ALL),
known AS (SELECT section, sum(qf * qf) AS q2 FROM qf
  WHERE EXISTS (SELECT 1 FROM tf WHERE tf.section = qf.section AND tf.token = qf.token) GROUP BY section),
dots AS (SELECT id, tf.section, sum(tf.tf * coalesce(qf, 0)) AS dot, sum(tf.tf * tf.tf) AS d2
  FROM tf LEFT JOIN qf ON tf.section = qf.section AND tf.token = qf.token GROUP BY ALL),
sets AS (SELECT id, section, list_distinct(list_filter(string_split(text, ' '), lambda t: t <> '')) AS ts FROM texts),
qs AS (SELECT section, list_distinct(list(term)) AS qs FROM terms GROUP BY section),
jac AS (SELECT id, sets.section, ts, len(list_intersect(ts, qs)) AS common,
    len(list_distinct(list_concat(ts, qs))) AS alls FROM sets JOIN qs USING (section)),
scored AS (SELECT jac.id, jac.section,
    CASE WHEN coalesce(dot, 0) > 0 THEN round(dot / (sqrt(d2) * sqrt(q2)), 12) ELSE 0.0 END AS cosine,
    CASE WHEN alls > 0 THEN round(common / alls, 12) END AS jaccard, ts
  FROM jac LEFT JOIN dots ON dots.id = jac.id AND dots.section = jac.section
  LEFT JOIN known ON known.section = jac.section),
matches AS (SELECT id, scored.section, string_agg(term, ' ' ORDER BY pos) AS matched
  FROM scored JOIN terms USING (section) WHERE cosine <> 0 AND list_contains(ts, term) GROUP BY ALL)"""


def rank(score: str, within: str) -> str:
    return f"""CASE WHEN {score} IS NOT NULL THEN
      rank() OVER (PARTITION BY {within} ORDER BY {score} DESC NULLS LAST)
      + (count(*) OVER (PARTITION BY {within}, {score}) - 1) / 2.0 END"""


RANKED = f"""
ranked AS (SELECT *, {rank("cosine", "section")} AS cosine_rank, {rank("jaccard", "section")} AS jaccard_rank FROM scored)"""

DOC_SECTIONS = (
    f"SELECT doc_id AS id, section, {token_text('text')} AS text FROM documents "
    f"CROSS JOIN (VALUES ('tasks'), ('profile'), ('benefits')) AS s(section)"
)
DOC_SCORES = f"WITH {TERMS}, {scores(DOC_SECTIONS)}"
WIDE = """
wide AS (SELECT id,
    max(jaccard) FILTER (section = 'tasks') AS tj, max(jaccard) FILTER (section = 'profile') AS pj,
    max(jaccard) FILTER (section = 'benefits') AS bj, max(cosine) FILTER (section = 'tasks') AS tc,
    max(cosine) FILTER (section = 'profile') AS pc, max(cosine) FILTER (section = 'benefits') AS bc
  FROM scored GROUP BY id)"""

# --- sources and sinks --------------------------------------------------------------
SQL["store_scan"] = "SELECT * FROM documents"
DOC_URL = "'https://' || source || '.example.com/jobs--' || lpad(doc_id::VARCHAR, 7, '0') || '-inline.html'"
SQL["store_write"] = f"""SELECT {DOC_URL} AS url, string_split(text, chr(10))[1] AS title, source AS company,
  text AS body, 0::BIGINT AS batch_no, doc_id AS pos FROM documents"""
# Six columns of the store are filled: url, title, company, parts, batch_no, pos.
SQL["store_init"] = f"""SELECT {DOC_URL} AS url, source AS company, len(string_split(text, chr(10)))::BIGINT AS n_parts,
  doc_id AS pos, 49::BIGINT AS n_missing FROM documents"""
SQL["store_append"] = """
SELECT 'doc-' || doc_id AS url, text, lang, 0::BIGINT AS batch_no, NULL::VARCHAR AS role FROM documents
UNION ALL
SELECT 'turn-' || conv_id || '-' || turn, text, NULL, 1, role FROM conversations"""
SQL["union_batches"] = """
SELECT doc_id, text, lang FROM documents
UNION ALL BY NAME SELECT conv_id, turn, role, text FROM conversations
UNION ALL BY NAME SELECT item_id, text FROM benchmark"""
SQL["page_scan"] = "SELECT page_id, url, html FROM pages"
PAGE_TITLE, PAGE_COMPANY = between("html", w.TITLE_MARKERS), between("html", w.COMPANY_MARKERS)
PAGE_TEXTS = f"SELECT page_id AS id, 'tasks' AS section, {token_text('array_to_string(' + parts('html', 'h1') + chr(44) + chr(39) + chr(32) + chr(39) + ')')} AS text FROM pages"
SQL["page_archive"] = f"""WITH {TERMS}, {scores(PAGE_TEXTS)}
SELECT url, {file_name(PAGE_COMPANY, PAGE_TITLE)} AS file_name, html
FROM pages JOIN scored ON page_id = id WHERE jaccard > 0.02"""
SQL["page_archive_stored"] = SQL["page_archive"]
SQL["store_overlap"] = """WITH rows AS (
  SELECT 'text-' || md5(text) AS url, length(text) AS n_chars, conv_id * 1000 + turn AS pos, 0 AS batch_no FROM conversations
  UNION ALL SELECT 'text-' || md5(text), length(text), doc_id, 1 FROM documents
  UNION ALL SELECT 'text-' || md5(text), length(text), item_id, 3 FROM benchmark)
SELECT url, n_chars::BIGINT AS n_chars, pos, batch_no::BIGINT AS batch_no FROM rows
QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch_no, pos) = 1"""
SQL["store_stream"] = f"""SELECT url, {PAGE_TITLE} AS title, {PAGE_COMPANY} AS company,
  array_to_string({parts("html", "h1")}, chr(10)) AS body FROM pages"""

# --- search plan and page extraction --------------------------------------------------
SQL["search_plan"] = f"""SELECT p_partkey, page, '{w.BASE}/jobs/' || replace(p_name, ' ', '-') || '/in-' || p_brand
  || '?radius=' || p_size || '&page=' || page
  || '&action=facet_selected%3bapplicationMethod%3bINTERNAL&am=INTERNAL' AS request_url
FROM part CROSS JOIN range(1, 4) AS r(page)"""
LINKS = f"""list_transform(list_filter(regexp_extract_all(html, 'href=[''"]?([^''" >]+)', 1),
  lambda u: NOT starts_with(u, 'https://')), lambda u: '{w.BASE}' || u)"""


def exploded(key: str, items: str, name: str, source: str) -> str:
    return f"""SELECT {key}, unnest(t) AS {name}, generate_subscripts(t, 1) - 1 AS pos
FROM (SELECT {key}, {items} AS t FROM {source})"""


SQL["extract_links"] = exploded("page_id", LINKS, "link", "pages")
SQL["links_per_page"] = f"SELECT page_id, len({LINKS})::BIGINT AS n_links FROM pages"
SQL["top_n_per_page"] = f"SELECT * FROM ({SQL['extract_links']}) WHERE pos < 3"
SQL["header_fields"] = f"SELECT page_id, {PAGE_COMPANY} AS company, {PAGE_TITLE} AS title FROM pages"
SQL["address_parse"] = f"""SELECT page_id, array_to_string({address_items(group1("html", w.ADDRESS_PATTERN))}, '|') AS address
FROM pages"""
SQL["address_clean"] = f"SELECT page_id, array_to_string({facts('html')}, '|') AS address FROM pages"
SQL["address_resolve"] = f"""
WITH companies AS (SELECT link, arg_min(html, page_id) AS html
  FROM (SELECT page_id, {group1("html", w.CARD_PATTERN)} AS link, html FROM pages) WHERE link IS NOT NULL GROUP BY link),
blocks AS (SELECT link, coalesce({", ".join(group1("html", p) for p in w.FACTS_PATTERNS)}) AS block FROM companies),
facts AS (SELECT link, {facts("block")} AS items FROM blocks),
ads AS (SELECT page_id, {address_items(group1("html", w.OWN_ADDRESS_PATTERN))} AS own,
  CASE WHEN contains(html, '<nav>') THEN {group1("html", w.CARD_PATTERN)} END AS link FROM pages)
SELECT page_id, array_to_string(coalesce(own, items, []), '|') AS address FROM ads LEFT JOIN facts USING (link)"""
SQL["heading_split"] = exploded("page_id", raw_parts("html", "h1"), "part", "pages")
SQL["strip_tags"] = exploded("page_id", parts("html", "h1"), "part", "pages")
SQL["drop_intro"] = f"""SELECT page_id, array_to_string(
  CASE WHEN len(string_split(html, '<p>')) - 1 > 8 THEN t[2:] ELSE t END, '|') AS parts
FROM (SELECT page_id, html, {parts("html", "h1")} AS t FROM pages)"""


def wide_parts(items: str) -> str:
    columns = ", ".join(f"coalesce({items}[{i}], '') AS part_{i}" for i in range(1, 12))
    return f"{columns}, len({items})::BIGINT AS n_parts, array_to_string({items}[12:], chr(31)) AS part_rest"


SQL["parts_to_columns"] = f"SELECT page_id, {wide_parts('t')} FROM (SELECT page_id, {parts('html', 'p')} AS t FROM pages)"

# --- row cleaning ---------------------------------------------------------------------
SQL["dedupe_first"] = """
WITH rows AS (SELECT text, doc_id, 1::BIGINT AS batch_no FROM documents
  UNION ALL SELECT text, conv_id * 1000 + turn, 0 FROM conversations)
SELECT text, doc_id, batch_no FROM rows
QUALIFY row_number() OVER (PARTITION BY text ORDER BY batch_no, doc_id) = 1"""
SQL["job_id"] = """SELECT url, CASE WHEN length(url) >= 19 THEN substr(url, length(url) - 18, 7)
  WHEN length(url) > 12 THEN left(url, length(url) - 12) ELSE '' END AS job_id FROM pages"""


def replaced(column: str) -> str:
    out = column
    for pattern, replacement, columns in fx.REPLACEMENTS:
        if column in columns:
            pattern = "chr(10)" if pattern == "\n" else q(pattern)
            out = f"replace({out}, {pattern}, {q(replacement)})"
    return f"{out} AS {column}"


SQL["replace_multi"] = f"""SELECT page_id, {replaced("company")}, {replaced("title")},
  {", ".join(replaced(f"part_{i}") for i in range(1, 12))}, n_parts, part_rest
FROM (SELECT page_id, {PAGE_COMPANY} AS company, {PAGE_TITLE} AS title, {wide_parts("t")}
  FROM (SELECT page_id, html, {raw_parts("html", "p")} AS t FROM pages))"""
MARKER = f"{word_list(fx.GENDER_MARKERS + [''])}[p_size % {len(fx.GENDER_MARKERS) + 1} + 1]"
MARKED = f"concat_ws(' ', p_name, {MARKER}, p_type, {MARKER})"
_title = MARKED
for _marker in fx.GENDER_MARKERS:
    _title = f"replace({_title}, {q(_marker)}, '')"
SQL["title_clean"] = f"SELECT p_partkey, trim({_title}) AS title FROM part"
SQL["title_blocklist"] = f"""SELECT p_partkey, title FROM (SELECT p_partkey, p_name || ' ' || p_type AS title FROM part)
WHERE NOT ({" OR ".join(f"contains(lower(title), {q(b.lower())})" for b in w.BLOCKLIST)})"""
SQL["title_blocklist_table"] = f"""WITH words AS (SELECT DISTINCT unnest({tokens(clean("text"))}) AS word FROM benchmark),
titled AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents)
SELECT doc_id, title FROM titled
WHERE NOT EXISTS (SELECT 1 FROM words WHERE length(word) > 8 AND contains(lower(title), word))"""
SQL["concat_text"] = """SELECT doc_id, concat_ws(' ', p[1], p[2]) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"""
SQL["language_detect"] = """
WITH grams AS (SELECT doc_id, lang, substr(text, i::BIGINT, 3) AS gram
  FROM (SELECT doc_id, lang, text, unnest(range(1, length(text) - 1)) AS i FROM documents)),
counts AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM counts) AS size FROM counts GROUP BY lang),
model AS (SELECT g.gram, s.lang, ln((coalesce(n, 0) + 1) / size) AS log
  FROM (SELECT DISTINCT gram FROM counts) g CROSS JOIN sizes s
  LEFT JOIN counts c ON c.gram = g.gram AND c.lang = s.lang),
scores AS (SELECT doc_id, model.lang, sum(log * n) AS score
  FROM (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL) JOIN model USING (gram) GROUP BY ALL)
SELECT doc_id, (SELECT lang FROM scores s WHERE s.doc_id = d.doc_id ORDER BY score DESC, lang LIMIT 1) AS detected
FROM documents d"""
SQL["language_of_turns"] = """
WITH grams AS (SELECT lang, substr(text, i::BIGINT, 3) AS gram
  FROM (SELECT lang, text, unnest(range(1, length(text) - 1)) AS i FROM documents)),
counts AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM counts) AS size FROM counts GROUP BY lang),
model AS (SELECT g.gram, s.lang, round(ln(coalesce(n, 0) + 1) * 1e9)::BIGINT - round(ln(size) * 1e9)::BIGINT AS log
  FROM (SELECT DISTINCT gram FROM counts) g CROSS JOIN sizes s
  LEFT JOIN counts c ON c.gram = g.gram AND c.lang = s.lang),
turns AS (SELECT conv_id || '-' || turn AS key, text FROM conversations),
turn_grams AS (SELECT key, substr(text, i::BIGINT, 3) AS gram
  FROM (SELECT key, text, unnest(range(1, length(text) - 1)) AS i FROM turns)),
scores AS (SELECT key, model.lang, sum(log * n) AS score
  FROM (SELECT key, gram, count(*) AS n FROM turn_grams GROUP BY ALL) JOIN model USING (gram) GROUP BY ALL)
SELECT key, (SELECT lang FROM scores s WHERE s.key = t.key ORDER BY score DESC, lang LIMIT 1) AS detected FROM turns t"""
EMAILS = rf"array_to_string(regexp_extract_all(text, '\b{fx.EMAIL_PATTERN}\b'), ',')"
SQL["extract_emails"] = f"SELECT doc_id, {EMAILS} AS emails FROM documents"


# --- section lookup ---------------------------------------------------------------------
def section(name: str, items: str = "p", fields: int = 0) -> str:
    """The cell after the first heading cell, by position i of the heading (1-based), after ``fields`` cells of the record."""
    lists = {n: keyword(words + w.EXTRA_KEYWORDS.get((s, n), [])) for (s, n), words in fx.SECTION_KEYWORDS.items() if s == name}
    start = {"benefits": fields + 2, "contact": fields + 6}.get(name, 1)
    hit = f"regexp_matches({items}[i], {q(lists[1])})"
    if name == "tasks":
        hit += f" OR (i IN ({fields + 1}, {fields + 2}) AND regexp_matches({items}[i], {q(lists[2])}))"
    if name == "benefits":
        hit += f" OR (i = {fields + 6} AND regexp_matches({items}[i], {q(lists[2])}))"
        hit += f" OR (regexp_matches({items}[i], {q(lists[3])}) AND coalesce(regexp_matches(left({items}[i + 1], 50), {q(lists[1])}), false))"
    cells = f"list_filter(range({start}, len({items}) + 1), lambda i: length({items}[i]) < 100)"
    found = f"list_filter({cells}, lambda i: {hit})"
    missing = "NULL" if name == "contact" else f"CASE WHEN len({cells}) > 0 THEN 'leer' END"
    return f"CASE WHEN len({found}) > 0 THEN {items}[{found}[1] + 1] ELSE {missing} END"


for _name in ("tasks", "profile", "benefits", "contact"):
    SQL[f"section_{_name}"] = f"""SELECT doc_id, {section(_name)} AS section
FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"""

for _name in ("tasks", "profile", "benefits", "contact"):
    SQL[f"section_{_name}_record"] = f"""SELECT doc_id, {section(_name, fields=5)} AS section FROM (
  SELECT doc_id, list_concat([substr(url, length(url) - 18, 7), url, t[1], source, lang], t) AS p
  FROM (SELECT *, {DOC_URL} AS url, string_split(text, chr(10)) AS t FROM documents))"""

# --- text normalisation ---------------------------------------------------------------------
SQL["clean_text"] = f"SELECT doc_id, {clean('text')} AS text FROM documents"
SQL["tokenize"] = exploded("doc_id", tokens(clean("text")), "token", "documents")
SQL["tokens_to_text"] = f"SELECT doc_id, {token_text('text')} AS text FROM documents"
SQL["lemmatize"] = f"""WITH {DOC_TOKENS},
lemmas AS (SELECT DISTINCT unnest({tokens(clean("text"))}) AS token FROM benchmark)
SELECT doc_id, string_agg(CASE WHEN l.token IS NOT NULL AND length(l.token) > 4 THEN left(l.token, 4) ELSE t.token END,
  ' ' ORDER BY pos) AS text
FROM doc_tokens t LEFT JOIN lemmas l ON t.token = l.token GROUP BY doc_id"""
for _name, _stem in (("stem_snowball", "stem1"), ("stem_cistem", "stem2")):
    SQL[_name] = f"""WITH RECURSIVE {DOC_TOKENS}, {VOCAB}, {STEMS}
SELECT doc_id, string_agg({_stem}, ' ' ORDER BY pos) AS text FROM doc_tokens JOIN stems USING (token) GROUP BY doc_id"""
SQL["stem_vocabulary"] = f"WITH RECURSIVE {DOC_TOKENS}, {VOCAB}, {STEMS} SELECT token, stem1, stem2 FROM stems"
SQL["remove_stopwords"] = f"""SELECT doc_id, array_to_string(list_filter({tokens(clean("text"))},
  lambda t: NOT list_contains({word_list(w.STOP_WORDS)}, t)), ' ') AS text FROM documents"""
SQL["prepare_terms"] = f"""WITH RECURSIVE
wanted AS (SELECT p_brand AS section, p_partkey AS pos, {tokens(clean("p_name || ' ' || p_type"))}[1] AS token FROM part),
vocab AS (SELECT DISTINCT token FROM wanted WHERE token IS NOT NULL), {STEMS}
SELECT section, pos, stem2 AS term FROM wanted JOIN stems USING (token)"""

# --- matching, scoring, ranking ------------------------------------------------------------------
SQL["term_counts"] = rf"""SELECT doc_id, token, count(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_extract_all({token_text("text")}, '[{WORD}]{{2,}}')) AS token FROM documents)
GROUP BY ALL"""
SQL["corpus_vocabulary"] = f"""{DOC_SCORES}
SELECT section, pos, term FROM terms WHERE EXISTS (
  SELECT 1 FROM tf WHERE tf.section = terms.section AND tf.token = terms.term)"""
for _name in w.TERMS:
    SQL[f"cosine_{_name}"] = f"{DOC_SCORES} SELECT id AS doc_id, round(cosine, 6) AS score FROM scored WHERE section = '{_name}'"
    SQL[f"jaccard_{_name}"] = f"{DOC_SCORES} SELECT id AS doc_id, round(jaccard, 6) AS score FROM scored WHERE section = '{_name}'"
for _name in ("tasks", "profile"):
    SQL[f"matched_{_name}"] = f"""{DOC_SCORES}
SELECT id AS doc_id, CASE WHEN cosine <> 0 THEN coalesce(matched, '') END AS matched
FROM scored LEFT JOIN matches USING (id, section) WHERE section = '{_name}'"""
SQL["rank_average"] = f"{DOC_SCORES}, {RANKED} SELECT id AS doc_id, section, jaccard_rank AS rank FROM ranked"
BATCHES = (
    f"SELECT id, section, text FROM (SELECT 'doc-' || doc_id AS id, {token_text('text')} AS text FROM documents "
    f"UNION ALL SELECT 'turn-' || conv_id || '-' || turn, {token_text('text')} FROM conversations) "
    f"CROSS JOIN (VALUES ('tasks'), ('profile')) AS s(section)"
)
SQL["rank_batches"] = f"WITH {TERMS}, {scores(BATCHES)}, {RANKED} SELECT id AS url, section, jaccard_rank AS rank FROM ranked"
SQL["rank_difference"] = f"""{DOC_SCORES}, {RANKED}
SELECT id AS doc_id, section, cosine_rank, jaccard_rank, abs(cosine_rank - jaccard_rank) AS rank_diff FROM ranked"""
SQL["rank_agreement"] = f"""{DOC_SCORES}, {RANKED}
SELECT section, round(avg(abs(cosine_rank - jaccard_rank)), 4) AS mean_rank_diff FROM ranked GROUP BY section"""
SQL["total_score"] = f"""{DOC_SCORES}, {WIDE}
SELECT id AS doc_id, round(tc + pc + bc / 2, 6) AS total_cosine, round(tj + pj + bj / 2, 6) AS total_jaccard FROM wide"""
SQL["jaccard_ranking"] = f"""{DOC_SCORES}, {RANKED}
SELECT id AS doc_id, round(jaccard, 6) AS jaccard, jaccard_rank AS rank FROM ranked WHERE section = 'tasks'"""

# --- selection and output tables --------------------------------------------------------------------
_t = w.THRESHOLDS
ENOUGH = f"""coalesce((tj > {_t["tasks"]} AND pj > {_t["profile"]} AND bj > {_t["benefits"]})
  OR tj + pj + bj / 2 > {_t["total"]}, false)"""
LETTERS = f"""{DOC_SCORES}, {WIDE},
letters AS (SELECT d.doc_id, source AS company, string_split(text, chr(10))[1] AS title, nullif({EMAILS}, '') AS email,
    CASE WHEN toxic = 1 THEN 'Ja' END AS done, {ENOUGH} AS enough, tj + pj + bj / 2 AS total_jaccard
  FROM wide JOIN documents d ON id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic = 1) l
    ON l.doc_id = d.doc_id),
marked AS (SELECT *, enough AND done IS DISTINCT FROM 'Ja' AS chosen FROM letters),
after AS (SELECT *, CASE WHEN chosen THEN {file_name("company", "title", prefix=fx.LETTER_PREFIX)} END AS file_name,
    CASE WHEN chosen THEN 'Ja' ELSE done END AS letter_done FROM marked)"""
SQL["select_eligible"] = f"{LETTERS} SELECT doc_id, round(total_jaccard, 6) AS total_jaccard FROM marked WHERE chosen"
SQL["mark_status"] = f"""{LETTERS} SELECT doc_id, file_name, letter_done,
  CASE WHEN email IS NOT NULL AND letter_done = 'Ja' THEN 'Ja' END AS sent FROM after"""
SQL["outbox"] = f"""{LETTERS} SELECT 'doc-' || doc_id AS url, email AS recipient, {fill(fx.MAIL_SUBJECT, title="title")} AS subject,
  {fill(fx.MAIL_BODY, title="title", name="'N. N.'")} AS body, 'letters/' || file_name || '.pdf' AS letter_path,
  'cv.pdf' AS cv_path, 'references.pdf' AS references_path
FROM after WHERE email IS NOT NULL AND letter_done = 'Ja'"""
SQL["status_merge"] = f"""SELECT 'doc-' || d.doc_id AS url,
  CASE WHEN l.toxic THEN 'withheld' WHEN l.good THEN {file_name("source", "lang", prefix=fx.LETTER_PREFIX)} END AS file_name,
  CASE WHEN l.good THEN 'Ja' END AS letter_done, CASE WHEN contains(text, '@') THEN 'Ja' END AS sent
FROM documents d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l
  ON l.doc_id = d.doc_id"""
SQL["safe_file_name"] = f"SELECT p_partkey, {file_name('p_brand', MARKED, prefix=fx.LETTER_PREFIX)} AS file_name FROM part"
SQL["address_lines"] = f"""SELECT page_id, coalesce(array_to_string(list_transform(CASE WHEN len(items) > 0 THEN items END, lambda a: a || chr(10)), ''),
  chr(10) || chr(10)) AS lines
FROM (SELECT page_id, {address_items(group1("html", w.OWN_ADDRESS_PATTERN))} AS items FROM pages)"""
SQL["render_text"] = f"""SELECT p_partkey, {q("Hamburg, den 02.01.2025")} AS place_date,
  replace(title, ' ', chr(10)) || chr(10) AS address_block,
  {fill(fx.SUBJECT_LINE, title="title")} AS subject_line, {q(fx.SALUTATION)} AS salutation,
  {fill(fx.LETTER_INTRO, title="title")} AS intro,
  {fill(fx.LETTER_CLOSING, about="'Als Teamplayer.'", start_date="'01.02.2025'")} AS closing
FROM (SELECT p_partkey, p_name || ' ' || p_type AS title FROM part)"""
SQL["render_prompt"] = f"""{DOC_SCORES}
SELECT id AS doc_id, {fill(fx.PROMPT, title="lang", company="source", matched="matched")} AS prompt
FROM scored LEFT JOIN matches USING (id, section) JOIN documents ON id = doc_id WHERE section = 'tasks'"""
SQL["tidy_text"] = f"SELECT doc_id, {strip('replace(text, chr(10), chr(32))')} AS text FROM documents"

# --- the whole path -----------------------------------------------------------------------------------
BLOCKED = " OR ".join(f"contains(lower(title), {q(b.lower())})" for b in fx.TITLE_BLOCKLIST)
_clean_title = "p[1]"
for _marker in fx.GENDER_MARKERS:
    _clean_title = f"replace({_clean_title}, {q(_marker)}, '')"
REPORT_TEXTS = """SELECT url AS id, section, coalesce(text, '') AS text FROM cells
  LEFT JOIN (SELECT url, section, string_agg(stem2, ' ' ORDER BY pos) AS text FROM cell_tokens JOIN stems USING (token)
    WHERE NOT list_contains(STOPS, stem2) GROUP BY ALL) USING (url, section)""".replace("STOPS", word_list(w.STOP_WORDS))
_columns = ", ".join(
    f"round(max({c}) FILTER (section = '{s}'), 6) AS {s}_{c}" if c != "matched"
    else f"max(matched) FILTER (section = '{s}') AS {s}_matched"
    for s in w.TERMS
    for c in ("cosine", "cosine_rank", "jaccard", "jaccard_rank", "rank_diff", "matched")
    if (s, c) != ("benefits", "matched")
)
_totals = ", ".join(
    f"round(max({m}) FILTER (section = 'tasks') + max({m}) FILTER (section = 'profile') "
    f"+ max({m}) FILTER (section = 'benefits') / 2, 6) AS total_{m}"
    for m in ("cosine", "jaccard")
)
REPORT = f"""kept AS (SELECT * FROM records WHERE NOT coalesce({BLOCKED}, false)),
cells AS (
  SELECT url, 'tasks' AS section, {section("tasks")} AS cell FROM kept
  UNION ALL SELECT url, 'profile', {section("profile")} FROM kept
  UNION ALL SELECT url, 'benefits', {section("benefits")} FROM kept),
cell_tokens AS (SELECT url, section, unnest(t) AS token, generate_subscripts(t, 1) AS pos
  FROM (SELECT url, section, {tokens(clean("cell"))} AS t FROM cells WHERE cell IS NOT NULL)),
raw_terms AS (SELECT section, pos, {tokens(clean("term"))}[1] AS token
  FROM (VALUES {TERM_ROWS}) AS v(section, pos, term)),
vocab AS (SELECT token FROM cell_tokens UNION SELECT token FROM raw_terms), {STEMS},
terms AS (SELECT section, pos, stem2 AS term FROM raw_terms JOIN stems USING (token)),
{scores(REPORT_TEXTS)}, {RANKED},
report AS (SELECT r.*, abs(cosine_rank - jaccard_rank) AS rank_diff,
    CASE WHEN cosine <> 0 THEN coalesce(matched, '') END AS matched
  FROM ranked r LEFT JOIN matches USING (id, section))"""
REPORT_ROWS = f"SELECT id AS url, {_columns}, {_totals} FROM report GROUP BY id"
SQL["fit_report"] = f"""WITH RECURSIVE
records AS (SELECT {DOC_URL} AS url, {strip(_clean_title)} AS title, p
  FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents)),
{REPORT}
{REPORT_ROWS}"""


def replaced_parts(items: str) -> str:
    for pattern, replacement, columns in fx.REPLACEMENTS:
        places = ", ".join(c[5:] for c in columns if c.startswith("part_"))
        pattern = "chr(10)" if pattern == "\n" else q(pattern)
        items = f"list_transform({items}, lambda x, i: CASE WHEN i IN ({places}) THEN replace(x, {pattern}, {q(replacement)}) ELSE x END)"
    return items


_p = w.PAGE_THRESHOLDS
SQL["page_letters"] = f"""WITH RECURSIVE
raw AS (SELECT url, {replaced("title")}, {replaced("company")}, {replaced_parts("t")} AS p
  FROM (SELECT url, {PAGE_TITLE} AS title, {PAGE_COMPANY} AS company, {parts("html", "p")} AS t FROM pages)),
records AS (SELECT url, {strip(_clean_title.replace("p[1]", "title"))} AS title, company, p FROM raw),
{REPORT},
rows AS ({REPORT_ROWS}),
addresses AS ({SQL["address_resolve"].replace("array_to_string(coalesce(own, items, []), '|') AS address", "coalesce(own, items, []) AS items")})
SELECT url, company, title, coalesce({EMAILS.replace("(text,", "(p[9],")}, '') AS email,
  {file_name("company", "title", prefix=fx.LETTER_PREFIX)} AS file_name, {q("Hamburg, den 02.01.2025")} AS place_date,
  coalesce(array_to_string(list_transform(CASE WHEN len(items) > 0 THEN items END, lambda a: a || chr(10)), ''), chr(10) || chr(10)) AS address_block,
  {fill(fx.SUBJECT_LINE, title="title")} AS subject_line, {q(fx.SALUTATION)} AS salutation, {fill(fx.LETTER_INTRO, title="title")} AS intro,
  {fill(fx.LETTER_CLOSING, about="'Als Teamplayer.'", start_date="'01.02.2025'")} AS closing,
  tasks_jaccard, profile_jaccard, benefits_jaccard, total_jaccard
FROM rows JOIN kept USING (url) JOIN pages USING (url) JOIN addresses USING (page_id)
WHERE (tasks_jaccard > {_p["tasks"]} AND profile_jaccard > {_p["profile"]} AND benefits_jaccard > {_p["benefits"]})
  OR total_jaccard > {_p["total"]}"""
