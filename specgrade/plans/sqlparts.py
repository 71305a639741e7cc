"""Shared fragments of the DuckDB oracle SQL (RE2 dialect, DuckDB syntax).

These are written independently of the Spark expressions on purpose: the
oracle is a second implementation of the same rule, not a copy of the plan.
"""

from specgrade.functions.urls import BLOG_DOMAINS, PARAM_SCHEMES

_DOM = "|".join(d.replace(".", r"\.") for d in BLOG_DOMAINS)



def _let(var: str, value: str, body: str) -> str:
    """``body`` with ``var`` bound to ``value``, evaluated once."""
    return f"list_transform([{value}], lambda {var}: {body})[1]"


def _url_sql(body: str) -> str:
    """Cuts a url at separators: scheme s_, rest r_, authority n_, path p_, its last segment l_."""
    out = _let("l_", "string_split(p_, '/')[-1]", body)
    out = _let("p_", "split_part(split_part(CASE WHEN n_ IS NULL THEN r_ ELSE substr(r_, 3 + length(n_)) END, '#', 1), '?', 1)", out)
    out = _let("n_", "CASE WHEN starts_with(r_, '//') THEN split_part(split_part(split_part(substr(r_, 3), '/', 1), '?', 1), '#', 1) END", out)
    out = _let("r_", "CASE WHEN s_ IS NULL THEN u_ ELSE substr(u_, length(s_) + 2) END", out)
    out = _let("s_", "CASE WHEN contains(u_, ':') AND regexp_full_match(split_part(u_, ':', 1), '[a-z][a-z0-9+.-]*') THEN split_part(u_, ':', 1) END", out)
    return _let("u_", "replace(replace(replace(ltrim(lower(url), ' ' || chr(9) || chr(10) || chr(13)), chr(9), ''), chr(10), ''), chr(13), '')", out)


URL_PARTS = f"""
  {_url_sql("CASE WHEN u_ IS NOT NULL THEN coalesce(split_part(string_split(n_, '@')[-1], ':', 1), '') END")} AS host,
  {_url_sql(f"CASE WHEN s_ IS NULL OR s_ IN {tuple(PARAM_SCHEMES)} THEN left(p_, length(p_) - length(l_)) || split_part(l_, ';', 1) ELSE p_ END")} AS path
"""

BLOG_REASON = rf"""
  CASE WHEN regexp_matches(host, '(?:^|\.)(?:{_DOM})$') THEN 'domain'
       WHEN regexp_matches(host, '(^|\.)blog[0-9]*\.') THEN 'subdomain'
       WHEN regexp_matches(path, '/(blog|blogs)(/|$)')
            AND NOT (contains(path, '/category/') OR contains(path, '/tag/') OR contains(path, '/author/'))
            THEN 'path'
  END
"""

# documents with a page url: page_id = doc_id % count(pages)
CORPUS = """
  (SELECT d.*, p.url FROM documents d
   JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages))
"""

# non-blank lines of documents.text
DOC_LINES = """
  list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')
"""

# Python str.strip() on text, for ASCII whitespace (DuckDB trim strips spaces only)
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
S = f"trim(text, {WS})"


def pystrip(expr: str) -> str:
    return f"trim({expr}, {WS})"

NL = "chr(10)"

# constraints_text derived table (same rule as plans.tables.constraints_text)
CONSTRAINTS_TEXT = f"""
  (SELECT doc_id AS instruction_number,
          'Constraints:' || chr(10) || coalesce(array_to_string(list_transform({DOC_LINES}, lambda x, i: i || '. ' || x), chr(10)), '') AS constraints,
          text AS content
   FROM documents)
"""

SATISFACTION_TEXT = f"""
  (SELECT doc_id AS instruction_number,
          coalesce(array_to_string(list_transform({DOC_LINES}, lambda x, i: i || CASE WHEN length(x) % 2 = 0 THEN '. Yes - x' ELSE '. No - x' END), chr(10)), '') AS satisfaction_results,
          CAST(len({DOC_LINES}) AS BIGINT) AS subset_size
   FROM documents)
"""

TASK_RESPONSES = f"""
  (SELECT doc_id AS instruction_number,
          'Here is the analysis.' || chr(10) || 'Main Task: ' || coalesce(({DOC_LINES})[1], '') || chr(10)
          || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Constraints:' || chr(10) END
          || coalesce(array_to_string(list_transform({DOC_LINES}, lambda x, i: i || '. ' || x), chr(10)), '')
          || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Main Task: ' || coalesce(({DOC_LINES})[2], '') ELSE '' END AS response
   FROM documents)
"""


def parse_numbered_sql(expr: str) -> str:
    """T1 in DuckDB: list of items."""
    s = f"regexp_replace(trim({expr}, {WS}), '(?i)^Constraints:\\s*', '')"
    return (f"list_transform(list_filter(regexp_split_to_array({s}, '\\n\\s*[0-9]+\\.\\s*'), lambda x: trim(x, {WS}) <> ''), "
            f"lambda x: trim(regexp_replace(x, '^[0-9]+\\.\\s*', ''), {WS}))")


def _tmpl(k, cat, x, y):
    return [
        f"'{cat}: A ' || {x} || ', B ' || {y}",
        f"'{cat} A (' || {x} || ') vs B (' || {y} || ')'",
        f"'{cat}' || chr(10) || 'A ' || {x} || '/5' || chr(10) || 'B ' || {y} || '/5'",
        f"'{cat}: A: ' || {x} || '.5 B: ' || {y}",
        f"'{cat}:' || chr(10) || 'A - ' || {x} || '/5' || chr(10) || 'B - ' || {y} || '/5'",
        f"'{cat}: A: ' || {x} || '/5, B: ' || {y} || '/5'",
    ][k]


def _s(v):
    return f"CAST((({v}) % 5 + 1) AS VARCHAR)"


_SC = {"Grammar": (_s("n_chars"), _s("n_chars // 7")), "Coherence": (_s("n_chars // 11"), _s("n_chars // 13")),
       "Likability": (_s("doc_id"), _s("doc_id // 3"))}

PAIR_EVAL_TEXT = "(SELECT doc_id AS instruction_number, CASE doc_id % 7 " + " ".join(
    f"WHEN {k} THEN " + " || chr(10) || ".join(_tmpl(k, c, x, y) for c, (x, y) in _SC.items())
    for k in range(6)) + " ELSE 'No scores given.' END AS evaluation FROM documents)"

_NUMRE = "([0-9]+(?:[.,][0-9]+)?)"


def _seg_sql(cat):
    low = "lower(replace(evaluation, chr(13), chr(10)))"
    st = f"strpos({low}, '{cat.lower()}')"
    ends = []
    for k in ("grammar", "coherence", "likability"):
        if k == cat.lower():
            continue
        p = f"strpos(substr({low}, {st} + 1), '{k}')"
        ends.append(f"CASE WHEN {p} > 0 THEN {st} + {p} ELSE length(evaluation) + 1 END")
    end = f"least({', '.join(ends)})"
    return f"CASE WHEN {st} > 0 THEN substr(replace(evaluation, chr(13), chr(10)), {st}, {end} - {st}) END"


def _num_sql(x):
    return f"CASE WHEN {x} <> '' THEN CAST(replace({x}, ',', '.') AS DOUBLE) END"


def pair_scores_sql(mode="fixed"):
    """A13+A14 in DuckDB over PAIR_EVAL_TEXT; columns as the Spark query."""
    cols = []
    for cat in ("Grammar", "Coherence", "Likability"):
        seg = _seg_sql(cat)
        nums = f"regexp_extract_all({seg}, '{_NUMRE}', 1)"
        fa = f"CASE WHEN len({nums}) >= 2 THEN {_num_sql(nums + '[1]')} END"
        fb = f"CASE WHEN len({nums}) >= 2 THEN {_num_sql(nums + '[2]')} END"
        if mode == "fixed":
            a = _num_sql(f"regexp_extract({seg}, '\\bA\\b\\s*[-:(=]*\\s*{_NUMRE}', 1)")
            b = _num_sql(f"regexp_extract({seg}, '\\bB\\b\\s*[-:(=]*\\s*{_NUMRE}', 1)")
            sa = f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN {a} ELSE {fa} END"
            sb = f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN {b} ELSE {fb} END"
        else:
            pre = f"A[^0-9\\r\\n\\-:]*{_NUMRE}\\D+B[^0-9\\r\\n\\-:]*{_NUMRE}"
            pa = _num_sql(f"regexp_extract({seg}, '{pre}', 1, 'i')")
            pb = _num_sql(f"regexp_extract({seg}, '{pre}', 2, 'i')")
            lre = "(^|\\n)\\s*{L}[^0-9A-Za-z\\r\\n\\-:]{{0,3}}" + _NUMRE + "(?:\\s*/\\s*[0-9]+)?"
            la = _num_sql(f"regexp_extract({seg}, '{lre.format(L='A')}', 2, 'i')")
            lb = _num_sql(f"regexp_extract({seg}, '{lre.format(L='B')}', 2, 'i')")
            sa = f"CASE WHEN ({pa}) IS NOT NULL THEN {pa} WHEN ({la}) IS NOT NULL AND ({lb}) IS NOT NULL THEN {la} ELSE {fa} END"
            sb = f"CASE WHEN ({pa}) IS NOT NULL THEN {pb} WHEN ({la}) IS NOT NULL AND ({lb}) IS NOT NULL THEN {lb} ELSE {fb} END"
        cols.append(f"({sa}) AS {cat.lower()}_a")
        cols.append(f"({sb}) AS {cat.lower()}_b")
    raw = f"(SELECT instruction_number, {', '.join(cols)} FROM {PAIR_EVAL_TEXT})"
    found = " OR ".join(f"{c}_a IS NOT NULL OR {c}_b IS NOT NULL" for c in ("grammar", "coherence", "likability"))
    sel = []
    for c in ("grammar", "coherence", "likability"):
        sel.append(f"CASE WHEN ok THEN coalesce({c}_a, 0.0) END AS {c}_score_A")
        sel.append(f"CASE WHEN ok THEN coalesce({c}_b, 0.0) END AS {c}_score_B")
    for c in ("grammar", "coherence", "likability"):
        sel.append(f"CASE WHEN ok THEN CASE WHEN coalesce({c}_a, 0.0) >= coalesce({c}_b, 0.0) THEN 'A' ELSE 'B' END END AS {c}_pref")
    wins = " + ".join(f"CASE WHEN coalesce({c}_a, 0.0) >= coalesce({c}_b, 0.0) THEN 1 ELSE 0 END"
                      for c in ("grammar", "coherence", "likability"))
    sel.append(f"CASE WHEN ok THEN CASE WHEN {wins} >= 3 - ({wins}) THEN 'A' ELSE 'B' END END AS overall_pref")
    sel.append("CASE WHEN ok THEN 0 ELSE 1 END AS needs_parsing")
    return (f"(SELECT instruction_number, {', '.join(sel)} FROM "
            f"(SELECT *, coalesce({found}, false) AS ok FROM {raw}))")

CONV_REQUESTS = "(SELECT conv_id * 100 + turn AS key, conv_id, turn, text AS prompt FROM conversations WHERE role = 'user')"


def word_count_sql(x):
    return f"(CASE WHEN trim({x}, {WS}) = '' THEN 0 ELSE len(string_split_regex(trim({x}, {WS}), '\\s+')) END)"


CONV_RESPONSES = f"""
  (SELECT 'chat:' || CAST(u.conv_id * 100 + u.turn AS VARCHAR) || ':1' AS request_id, u.conv_id * 100 + u.turn AS key,
          1 AS attempt, a.text AS text, CAST({word_count_sql('u.text')} AS BIGINT) AS input_tokens,
          CAST({word_count_sql('a.text')} AS BIGINT) AS output_tokens, CAST(NULL AS VARCHAR) AS error
   FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
   WHERE u.role = 'user' AND a.role = 'assistant')
"""

ATTEMPT_LOG = f"""
  (SELECT key, attempt,
          CASE WHEN attempt < n OR (7 * conv_id + turn) % 5 = 0 THEN 'RateLimitError' END AS error
   FROM (SELECT key, conv_id, turn, 1 + (conv_id + turn) % 3 AS n FROM {CONV_REQUESTS}) r,
        LATERAL (SELECT unnest(generate_series(1, n)) AS attempt))
"""


# Python's str.isspace() characters as an RE2 class (fixed values: the
# Unicode White_Space set plus the four ASCII separators \x1c-\x1f)
PY_WS_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def inline_segments_sql(src: str, key: str, text: str) -> str:
    """T2 segment parser in DuckDB without look-ahead (RE2 has none).

    A recursive scan over each text: a step takes the next 'digits.' marker
    that starts a word (previous character not a letter, number or '_')
    plus the whitespace after it, then the text up to the next place where
    optional whitespace, digits and a dot follow (or the end).  The state
    keeps one character before the unread rest, so the word-start test sees
    it.  Output: (key, pos, segment), whitespace runs collapsed, empty
    segments dropped, pos counted from 0 over the kept segments."""
    ws = PY_WS_CLASS
    marker = rf"(?s)^.*?[^\pL\pN_]\p{{Nd}}+\.{ws}*"
    upto = rf"(?s)^(.*?){ws}*\p{{Nd}}+\."
    return f"""
  (WITH RECURSIVE scan(k_, n_, x_, seg_) AS (
     SELECT {key}, 0, ' ' || {text}, CAST(NULL AS VARCHAR) FROM {src} WHERE {text} IS NOT NULL
     UNION ALL
     SELECT k_, n_ + 1, right(m_ || s_, 1) || substr(r_, length(s_) + 1), s_
     FROM (SELECT k_, n_, m_, r_,
                  CASE WHEN regexp_matches(r_, '\\p{{Nd}}\\.') THEN regexp_extract(r_, '{upto}', 1) ELSE r_ END AS s_
           FROM (SELECT k_, n_, m_, substr(x_, length(m_) + 1) AS r_
                 FROM (SELECT k_, n_, x_, regexp_extract(x_, '{marker}', 0) AS m_ FROM scan) a
                 WHERE m_ <> '') b) c)
   SELECT k_ AS {key}, CAST(row_number() OVER (PARTITION BY k_ ORDER BY n_) - 1 AS INTEGER) AS pos, seg AS segment
   FROM (SELECT k_, n_, trim(regexp_replace(seg_, '{ws}+', ' ', 'g')) AS seg FROM scan WHERE n_ > 0) t
   WHERE seg <> '')
"""


# MurmurHash3 x86_32 (the public algorithm; fixed values: its constants and
# Spark's feature-hashing seed 42), 32-bit arithmetic kept in UBIGINT
_M3_C1, _M3_C2, _M3_N = 3432918353, 461845907, 3864292196
_M3_F1, _M3_F2 = 2246822507, 3266489909
_M3_SEED = 42


def _mul32(x: str, c: int) -> str:
    return f"((({x}) * {c}::UBIGINT) % 4294967296)"


def _rotl32(x: str, r: int) -> str:
    return f"(((({x}) << {r}) | (({x}) >> {32 - r})) % 4294967296)"


def _mixk(k: str) -> str:
    return _mul32(_rotl32(_mul32(k, _M3_C1), 15), _M3_C2)


def hashed_tokens_sql(src: str, key: str, text: str, dim: int) -> str:
    """(key, tok, bucket): lower-cased text split on runs of characters
    other than letters, marks, digits and connectors, each token's UTF-8 bytes
    hashed with MurmurHash3 x86_32 and reduced mod ``dim``."""
    byte = "CAST('0x' || substr(hx, 2 * ({i}) - 1, 2) AS UBIGINT)"
    block = " + ".join(f"({byte.format(i=f'4 * b + {j + 1}')} << {8 * j})" for j in range(4))
    tail = " + ".join(f"(CASE WHEN (len(hx) // 2) % 4 > {j} THEN {byte.format(i=f'4 * ((len(hx) // 2) // 4) + {j + 1}')} "
                      f"ELSE 0 END << {8 * j})" for j in range(3))
    step = _mul32(_rotl32("xor(h, k)", 13), 5)
    return f"""
  (SELECT {key}, tok, CAST(h5 % {dim} AS INTEGER) AS bucket FROM (
    SELECT *, xor(h4, h4 >> 16) AS h5 FROM (
    SELECT *, {_mul32("xor(h3, h3 >> 13)", _M3_F2)} AS h4 FROM (
    SELECT *, {_mul32("xor(h2, h2 >> 16)", _M3_F1)} AS h3 FROM (
    SELECT *, xor(xor(h1, {_mixk("t1")}), (len(hx) // 2)::UBIGINT) AS h2 FROM (
    SELECT {key}, tok, hx,
           list_reduce(list_transform(range(0, (len(hx) // 2) // 4), lambda b: {_mixk(block)}),
                       lambda h, k: ({step} + {_M3_N}) % 4294967296, {_M3_SEED}::UBIGINT) AS h1,
           {tail} AS t1
    FROM (SELECT {key}, tok, hex(encode(tok)) AS hx
          FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'),
                                                 lambda t: t <> '')) AS tok FROM {src}) w) s) a) b) c) d) e)
"""
