"""Queries over texts and tool calls (B operators)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.functions import scores
from memlens.functions import text as T
from memlens.functions import tools as TL
from memlens.functions import user as U
from memlens.operators import mining as M
from memlens.plans import adapters as D
from memlens.plans import sqlbase as S
from memlens.plans.catalog import Query, Registry, rounded

QUERIES: Registry = {}


def _q(key, run, sql=None):
    QUERIES[key] = Query(lambda spark, sf: rounded(run(spark, sf)), sql)


def _docs(cols, marked=False):
    """Columns over documents; ``cols`` is called when the query runs, since columns need a session."""
    source = D.marked_documents if marked else D.documents
    return lambda s, sf: source(s, sf).select("doc_id", *cols(F.col("text")))


_trim = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_flat = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"

# B1: order of first appearance is kept, so the SQL ranks tokens by their first position.
_q("b1_tokenize", _docs(lambda t: [F.array_join(T.tokenize(t), " ").alias("tokens")]), S.with_(f"""w AS (SELECT doc_id, {S.words_expr('text')} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS t, unnest(range(len(ws))) AS i FROM w),
f AS (SELECT doc_id, t, min(i) AS i FROM u WHERE t<>'' AND t NOT IN {S.in_list(V.STOP_WORDS)} GROUP BY 1,2),
g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS tokens FROM f GROUP BY 1)""",
  select="SELECT doc_id, coalesce(tokens,'') AS tokens FROM documents LEFT JOIN g USING (doc_id)"))


def _features():
    text = F.col("text")
    path = F.concat(F.lit("src/f."), F.element_at(F.array(*[F.lit(x) for x in ("py", "ts", "txt")]), (F.col("doc_id") % 3 + 1).cast("int")))
    lang = F.when(F.col("doc_id") % 2 == 0, F.upper("lang"))
    fw = F.when(F.col("doc_id") % 5 == 0, F.col("source"))
    return T.features(text, path, lang, fw, F.lit(None).cast("string"))


def _label(col, rules):
    out = "CASE "
    for pattern, label in rules:
        value = f"{S.q(label.replace('$1', ''))}||regexp_extract({col}, {S.q(pattern)}, 1)" if "$1" in label else S.q(label)
        out += f"WHEN {S.rx(col, pattern)} THEN lower({value}) "
    return out + "END"


_EXT = "(['py','ts','txt'])[(doc_id%3+1)::INT]"
_FEAT = f"""ft AS (SELECT doc_id, lang, source, {_label('text', V.ERROR_TYPE_PATTERNS)} AS error_type,
  nullif(regexp_extract(text, {S.q(V.ERROR_CODE_PATTERN)}, 1),'') AS error_code,
  CASE WHEN doc_id%2=0 THEN lower(lang) ELSE CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' END END AS language,
  CASE WHEN doc_id%5=0 THEN lower(source) ELSE {_label('text', V.FRAMEWORK_PATTERNS)} END AS framework, {_EXT} AS file_extension,
  list_sort(list_filter({S.token_set('text')}, lambda x: length(x)>2)) AS kw, text FROM md)"""
_q("b2_extract_features", lambda s, sf: D.marked_documents(s, sf).withColumn("f", _features()).select(
    "doc_id", "f.error_type", "f.error_code", "f.language", "f.framework", "f.file_extension",
    F.array_join(F.array_sort("f.keywords"), " ").alias("keywords")),
   S.with_(S.MARKED, _FEAT, select="SELECT doc_id, error_type, error_code, language, framework, file_extension, array_to_string(kw,' ') AS keywords FROM ft"))

_CUSTOM = {"ticket": r"(?i)error (\d+)", "secret": r"sk-[a-z]+", "vendor": r"(?i)\b(django|next)\b"}


def _canon(custom="[]"):
    return (f"array_to_string(list_concat(list_concat(list_filter(['err:'||error_type, 'code:'||error_code, 'lang:'||language, 'fw:'||framework], "
            f"lambda x: x IS NOT NULL), {custom}), kw), '|')")


_q("b3_fingerprint", lambda s, sf: D.marked_documents(s, sf).select("doc_id", T.fingerprint(_features()).alias("fingerprint")),
   S.with_(S.MARKED, _FEAT, select=f"SELECT doc_id, sha256({_canon()}) AS fingerprint FROM ft"))
_cust = lambda n, p, g: f"CASE WHEN {S.rx('text', p)} THEN '{n}:'||lower(regexp_extract(text, {S.q(p)}, {g})) END"
_CUSTOM_SQL = ("list_filter([" + ", ".join(_cust(n, p, 1 if "(" in p.replace("(?", "") else 0) for n, p in sorted(_CUSTOM.items())) + "], lambda x: x IS NOT NULL)")
_q("b24_custom_features", lambda s, sf: D.marked_documents(s, sf).withColumn("c", T.custom_features(F.col("text"), _CUSTOM)).select(
    "doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("c")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("custom"),
    T.fingerprint(_features(), F.col("c")).alias("fingerprint")),
   S.with_(S.MARKED, _FEAT, select=f"SELECT doc_id, array_to_string({_CUSTOM_SQL}, ',') AS custom, sha256({_canon(_CUSTOM_SQL)}) AS fingerprint FROM ft"))



def _by_hand():
    """What the patterns of _CUSTOM find, as Python functions."""
    def named(pattern):
        rule = re.compile(pattern, re.ASCII)
        return lambda text: (m := rule.search(text)) and (m.group(1) if rule.groups else m.group(0))

    return {name: named(pattern) for name, pattern in _CUSTOM.items()}


_q("b24_user_functions", lambda s, sf: U.user_features(D.marked_documents(s, sf), "text", _by_hand()).select(
    "doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("custom")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("custom"),
    T.fingerprint(_features(), F.col("custom")).alias("fingerprint")), QUERIES["b24_custom_features"].sql)

_KW = (f"list_sort(list_distinct(list_concat({S.split_set('situation', '[^a-z0-9_.]+', 2, V.BLOCK_STOP_WORDS)}, list_concat("
       "list_filter(['lang:'||lower(language), 'fw:'||lower(framework)], lambda x: x IS NOT NULL), list_transform(apis, lambda a: 'api:'||lower(a))))))")
_q("b4_block_keywords", lambda s, sf: D.blocks(s, sf).withColumn("situation", F.col("mechanism")).withColumn(
    "kw", T.block_keywords(F.col("situation"), F.col("language"), F.col("framework"), F.lit(None).cast("string"), F.col("apis"))).select(
    "block_id", F.array_join("kw", " ").alias("keywords"),
    T.block_fingerprint(F.col("language"), F.col("framework"), F.lit(None).cast("string"), F.col("apis"), F.col("kw")).alias("fingerprint")),
   S.with_(S.BLOCKS, f"b2 AS (SELECT * REPLACE (mechanism AS situation) FROM blk), k AS (SELECT *, {_KW} AS kw FROM b2)", select="""
SELECT block_id, array_to_string(kw,' ') AS keywords, sha256('lang='||lower(coalesce(language,''))||'|fw='||lower(coalesce(framework,''))||'|err=|api='
  ||array_to_string(list_sort(list_transform(apis, lambda a: lower(a))),',')||'|kw='||array_to_string(kw,',')) AS fingerprint FROM k"""))

_q("b5_scan_leakage", _docs(lambda t: [T.leakage(t).alias("rule")], marked=True),
   S.with_(S.MARKED, select=f"SELECT doc_id, {S.first_rule('text', [*V.LEAKAGE_CORE, *V.LEAKAGE_EXTENDED])} AS rule FROM md"))
_RE2_INJECTION = [(n, r"(?i)(^|[^`])<\s*/?\s*(system|user|assistant)\s*>([^`]|$)" if n == "system-spoof" else p) for n, p in V.PROMPT_INJECTION]
_q("b6_scan_prompt_injection", _docs(lambda t: [T.prompt_injection(t).alias("rule")], marked=True),
   S.with_(S.MARKED, select=f"SELECT doc_id, {S.first_rule('text', _RE2_INJECTION)} AS rule FROM md"))

_NOISE = T.release_noise_rules()
_any = lambda col, rules: "(" + " OR ".join(S.rx(col, p) for p in rules) + ")"
_gate = lambda body, ver: f"CASE WHEN {_any(body, _NOISE)} THEN 'release-noise' WHEN {S.rx(_trim(ver), V.TEMPLATE_VERIFY)} THEN 'template-verify' ELSE 'accept' END"


def _marked_blocks(s, sf):
    return D.blocks(s, sf).withColumn("mechanism", F.concat_ws("\n", "mechanism", D.marker(F.col("n")))).withColumn("verification", F.coalesce("verification", F.lit("")))


_MBLK = S.BLOCKS + """,
mb AS (SELECT * REPLACE (mechanism||chr(10)||(SELECT m FROM md0 WHERE md0.doc_id=blk.n) AS mechanism, coalesce(verification,'') AS verification) FROM blk)"""
_MB = S.MARKED + ",\n" + _MBLK
_BODY = "situation||chr(10)||mechanism||chr(10)||unlock"
_q("b7_capture_gate", lambda s, sf: _marked_blocks(s, sf).select("block_id", T.capture_gate(
    F.col("situation"), F.col("mechanism"), F.col("unlock"), F.col("verification")).alias("gate")),
   S.with_(_MB, select=f"SELECT block_id, {_gate(_BODY, 'verification')} AS gate FROM mb"))



def _lead():
    return F.concat(D.marker(F.col("doc_id")), F.lit(" "), F.col("text"))


_PRUNE = (f"CASE WHEN {_any('t', V.META_WRAP_LEADS)} THEN 'meta-wrap-lead' WHEN {_any('t', V.PROJECT_MANAGEMENT_LEADS)} THEN 'project-management-lead' "
          f"WHEN NOT {S.rx('t', V.PROBLEM_SIGNAL)} THEN 'no-problem-signal' END")
_q("b8_prune_classify", lambda s, sf: D.documents(s, sf).select("doc_id", T.prune_reason(_lead()).alias("reason")).withColumn(
    "confidence", F.when(F.col("reason") == "no-problem-signal", "low").when(F.col("reason").isNotNull(), "high")),
   S.with_(S.MARKED, "t AS (SELECT doc_id, m||' '||text AS t FROM md0)", f"r AS (SELECT doc_id, {_PRUNE} AS reason FROM t)",
           select="SELECT doc_id, reason, CASE WHEN reason='no-problem-signal' THEN 'low' WHEN reason IS NOT NULL THEN 'high' END AS confidence FROM r"))

_pl = lambda c: _flat(f"regexp_replace(regexp_replace({c}, '(?m)^[ \\t]*#+[ \\t]*', '', 'g'), '`+', '', 'g')")
_JUNK_NOISE = [*V.JUNK_NOISE, r"(?im)^[ \t]*##?[ \t]*summary[ \t]*[—-]"]
_JUNK = f"""jp AS (SELECT *, {_pl('situation')} AS s1, {_pl('mechanism')} AS m1, {_pl('unlock')} AS u1 FROM mb),
jt AS (SELECT *, lower(s1||' '||m1||' '||u1) AS corpus, {S.split_set('s1', '[^a-z0-9]+', 3)} AS ts, {S.split_set('m1', '[^a-z0-9]+', 3)} AS tm FROM jp),
jk AS (SELECT *, CASE WHEN {S.jac('ts', 'tm', '1.0')} >= 0.8 THEN 'junk-self-ref' WHEN {_any('corpus', _JUNK_NOISE)} THEN 'junk-release-noise'
  WHEN length(s1)<30 OR length(m1)<30 OR length(u1)<30 THEN 'junk-empty' WHEN {S.rx(_trim('verification'), V.TEMPLATE_VERIFY)} THEN 'junk-template' ELSE 'reusable' END AS category,
  {_gate(_BODY, 'verification')} AS gate FROM jt)"""
_q("b9_junk_rate", lambda s, sf: M.junk_rate(_marked_blocks(s, sf)), S.with_(_MB, _JUNK, select="""
SELECT category, count(*) AS n, count(*) FILTER (gate<>'accept') AS gate_rejects, round(count(*)/sum(count(*)) OVER (),6)::DOUBLE AS share FROM jk GROUP BY 1"""))
_q("b9_gate_quality", lambda s, sf: M.gate_quality(_marked_blocks(s, sf)), S.with_(_MB, _JUNK, select="""
SELECT count(*) AS blocks, count(*) FILTER (category<>'reusable') AS junk, round(count(*) FILTER (category<>'reusable')/count(*),6) AS junk_rate,
  round(count(*) FILTER (category<>'reusable' AND gate<>'accept')/nullif(count(*) FILTER (category<>'reusable'),0),6) AS gate_recall,
  round(count(*) FILTER (category='reusable' AND gate<>'accept')/nullif(count(*) FILTER (category='reusable'),0),6) AS gate_false_positive FROM jk"""))


def _calls(s, sf):
    """Tool calls whose summaries carry the whole text of documents and a mix of flags."""
    tool = F.element_at(F.array(*[F.lit(t) for t in (*V.TOOL_FAMILY, "Mystery")]), (F.col("doc_id") % (len(V.TOOL_FAMILY) + 1) + 1).cast("int"))
    summary = F.when(F.col("doc_id") % 2 == 0, F.concat(tool, F.lit("(-r --hidden '"), F.col("text"), F.lit("')"))).otherwise(F.concat(F.lit("-n "), F.col("text")))
    return D.documents(s, sf).select("doc_id", tool.alias("tool"), summary.alias("summary"))


_TOOLS = [*V.TOOL_FAMILY, "Mystery"]
_CALLS = f"""ca0 AS (SELECT doc_id, ({S.arr(_TOOLS)})[(doc_id%{len(_TOOLS)}+1)::INT] AS tool, text FROM documents),
ca AS (SELECT doc_id, tool, CASE WHEN doc_id%2=0 THEN tool||'(-r --hidden '''||text||''')' ELSE '-n '||text END AS summary FROM ca0)"""


def intent_sql(summary, tool):
    inner = f"CASE WHEN regexp_matches({summary}, '(?s)^[A-Za-z][A-Za-z0-9]*\\(.*\\)\\s*$') THEN regexp_extract({summary}, '(?s)^[A-Za-z][A-Za-z0-9]*\\((.*)\\)\\s*$', 1) ELSE {summary} END"
    signs = "[*?\\[\\]()\\\\^$+|.{}/#''\"`_\\-\\s]+"
    toks = f"string_split(trim(regexp_replace(lower({inner}), '{signs}', ' ', 'g')), ' ')"
    return f"rtrim({S.FAMILY(tool)}||':'||array_to_string(list_filter({toks}, lambda x: x<>'' AND x NOT IN {S.in_list(V.INTENT_FLAG_WORDS)}), ' '))"


_q("b10_intent_key", lambda s, sf: _calls(s, sf).select("doc_id", TL.intent_key(F.col("summary"), F.col("tool")).alias("intent_key")),
   S.with_(_CALLS, select=f"SELECT doc_id, {intent_sql('summary', 'tool')} AS intent_key FROM ca"))
_q("b11_tool_family", lambda s, sf: _calls(s, sf).groupBy("tool").agg(F.count("*").alias("n")).withColumn("family", TL.tool_family(F.col("tool"))),
   S.with_(_CALLS, select=f"SELECT tool, count(*) AS n, {S.FAMILY('tool')} AS family FROM ca GROUP BY 1"))


def _sanitized(s, sf):
    d = D.marked_documents(s, sf)
    tool = F.element_at(F.array(*[F.lit(t) for t in ("Read", "Grep", "Glob", "Bash", "Edit")]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/repo/src/"), F.col("source"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("./lib/"), F.col("lang"))).otherwise(F.lit("../out"))
    return d.select("doc_id", tool.alias("tool"), TL.sanitize_args(tool, path, F.col("text"), F.col("text"), "/repo", "salt").alias("a")).select("doc_id", "tool", "a.arg_summary", "a.arg_key")


_q("b12_sanitize_tool_args", _sanitized)

_q("b13_summarize_files", lambda s, sf: M.summarize_files(D.files(s, sf)))
_SORTED = lambda c: F.array_join(F.array_sort(c), ",")
_ln = lambda p, src="ls": f"list_filter(list_transform({src}, lambda l: regexp_extract(l, {S.q(p)}, 1)), lambda x: x<>'')"
_srt = lambda e: f"array_to_string(list_sort(list_distinct({e})),',')"
_LANG = "CASE regexp_extract(lower(rel_path), '\\.([a-z0-9]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in V.FILE_LANGUAGE_BY_EXTENSION.items()) + " ELSE 'plain' END"
_GO_IN = "list_filter(ls, lambda l: regexp_matches(l, '^([a-z]+ )?\"[^\"]+\"$'))"  # block rows of the adapter's import list
_q("b13_file_symbols", lambda s, sf: D.files(s, sf).withColumn("language", M.file_language(F.col("rel_path"))).withColumn(
    "b", M.file_symbols(F.col("language"), F.col("content"))).select("file_id", "language", _SORTED("b.imports").alias("imports"), _SORTED("b.exports").alias("exports"), _SORTED("b.symbols").alias("symbols")),
   S.with_(S.FILES, f"""fl AS (SELECT file_id, {_LANG} AS language, list_transform(string_split(content, chr(10))[1:400], lambda l: {_trim('l')}) AS ls,
  string_split(content, chr(10))[1:400] AS raws FROM fil),
fm AS (SELECT *, list_filter(ls, lambda l: NOT regexp_matches(l, {S.q(V.TS_IMPORT)})) AS rest,
  list_filter(ls, lambda l: regexp_matches(l, '^export\\s*\\{{')) AS rex FROM fl)""", select=f"""
SELECT file_id, language, CASE language WHEN 'typescript' THEN {_srt(f"list_concat({_ln(V.TS_IMPORT)}, {_ln(V.TS_REQUIRE, 'rest')})")}
   WHEN 'python' THEN {_srt(f"list_concat({_ln(V.PY_FROM)}, {_ln(V.PY_IMPORT)})")} WHEN 'go' THEN {_srt(f"list_transform({_GO_IN}, lambda l: regexp_extract(l, '\"([^\"]+)\"', 1))")}
   WHEN 'rust' THEN {_srt(_ln(V.RS_USE))} ELSE '' END AS imports,
  CASE language WHEN 'typescript' THEN {_srt(f"list_concat({_ln(V.TS_EXPORT, 'rest')}, list_transform(flatten(list_transform(rex, lambda l: string_split(regexp_extract(l, {S.q(V.TS_REEXPORT)}, 1), ','))), lambda x: trim(string_split_regex(trim(x), '[ ]as[ ]')[-1])))")}
   WHEN 'go' THEN {_srt(f"list_filter(list_concat({_ln(V.GO_FUNC)}, {_ln(V.GO_TYPE)}), lambda n: regexp_matches(n, '^[A-Z]'))")}
   WHEN 'rust' THEN {_srt(f"list_concat({_ln(V.RS_FN, chr(34) + 'pubs' + chr(34))}, {_ln(V.RS_TYPE, chr(34) + 'pubs' + chr(34))})")} ELSE '' END AS exports,
  CASE language WHEN 'typescript' THEN {_srt(_ln(V.TS_DECL, 'rest'))} WHEN 'python' THEN {_srt(f"list_concat({_ln(V.PY_DEF, 'raws')}, {_ln(V.PY_CLASS, 'raws')})")}
   WHEN 'go' THEN {_srt(f"list_concat(list_transform({_ln(V.GO_PACKAGE)}[1:1], lambda p: 'pkg:'||p), list_concat({_ln(V.GO_FUNC)}, {_ln(V.GO_TYPE)}))")}
   WHEN 'rust' THEN {_srt(f"list_concat({_ln(V.RS_FN)}, {_ln(V.RS_TYPE)})")} ELSE '' END AS symbols
FROM (SELECT *, list_filter(ls, lambda l: starts_with(l, 'pub ')) AS pubs FROM fm)"""))


def _outputs():
    """Terminal output: every document twice with colour codes and repeated lines."""
    esc = "\x1b[31m"
    m = D.marker(F.col("doc_id"))
    return F.concat(F.lit(esc), m, F.lit("\x1b[0m\n"), m, F.lit("\n"), m, F.lit("\n"), F.col("text"))


_q("b14_normalize_tool_output", lambda s, sf: D.documents(s, sf).select("doc_id", TL.normalize_output(_outputs()).alias("output")), S.with_(S.MARKED, """
o AS (SELECT doc_id, string_split(m||chr(10)||m||chr(10)||m||chr(10)||text, chr(10)) AS ls FROM md0),
u AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM o),
s AS (SELECT *, CASE WHEN l = lag(l) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS b FROM u),
g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM s),
r AS (SELECT doc_id, grp, min(i) AS i, any_value(l) AS l, count(*) AS n FROM g GROUP BY 1,2),
f AS (SELECT doc_id, string_agg(CASE WHEN n>1 THEN l||chr(10)||'... [repeated '||(n-1)||' lines by memlens]' ELSE l END, chr(10) ORDER BY i) AS t FROM r GROUP BY 1)""", select=f"""
SELECT doc_id, CASE WHEN length(t)<={V.TOOL_OUTPUT_CHARS} THEN t ELSE t[1:{V.TOOL_OUTPUT_CHARS}] || CASE WHEN len(string_split(t,chr(10)))>len(string_split(t[1:{V.TOOL_OUTPUT_CHARS}],chr(10)))
  THEN chr(10)||'... ['||(len(string_split(t,chr(10)))-len(string_split(t[1:{V.TOOL_OUTPUT_CHARS}],chr(10))))||' lines truncated by memlens]'
  ELSE chr(10)||'... [truncated by memlens: '||(length(t)-{V.TOOL_OUTPUT_CHARS})||' chars omitted]' END END AS output FROM f"""))

# Exchanges get a question and a few fact-bearing lines so that every rule has something to find.
_TAIL = ["Run `npm test` now.", "The `src/core/a.ts` contains the parser.", "It uses ESLint here.", "Needs Node >= 18.2 to work.",
         "Set the flag in the config file.", "Re-run the tests to check it."]


def _pairs(s, sf):
    p = M.exchanges(D.turns(s, sf))
    n = F.length("assistant_text")
    tail = lambda k: F.element_at(F.array(*[F.lit(x) for x in _TAIL]), ((n + k) % len(_TAIL) + 1).cast("int"))
    return p.withColumn("user_text", F.concat("user_text", F.lit(" Why does this fail? It did work before."))).withColumn(
        "assistant_text", F.concat("assistant_text", F.lit("\n\n"), tail(0), F.lit("\n"), tail(1), F.lit("\n"), tail(2), F.lit("\n")))


_tl = lambda k: f"({S.arr(_TAIL)})[((length(a.content)+{k})%{len(_TAIL)}+1)::INT]"
_PAIRS = S.TURNS + f""",
pr AS (SELECT a.session_id, a.turn, u.content||' Why does this fail? It did work before.' AS user_text,
  a.content||chr(10)||chr(10)||{_tl(0)}||chr(10)||{_tl(1)}||chr(10)||{_tl(2)}||chr(10) AS assistant_text
  FROM trn a JOIN trn u ON u.session_id=a.session_id AND u.turn+1=a.turn AND u.role='user' WHERE a.role='assistant')"""
_STRIP = lambda c: f"regexp_replace({c}, '(?s)```.*?```', '', 'g')"
_ra = lambda p, g=1: f"regexp_extract_all(c, {S.q(p)}, {g})"
_q("b15_extract_facts", lambda s, sf: M.extract_facts(_pairs(s, sf)), S.with_(_PAIRS, f"""c AS (SELECT session_id, turn, {_STRIP("user_text||chr(10)||chr(10)||assistant_text")} AS c FROM pr),
a AS (SELECT session_id, turn, list_concat(list_concat(list_transform(list_filter({_ra(V.FACT_COMMAND)}, lambda x: {S.rx('trim(x)', V.FACT_COMMAND_HEAD)}), lambda x: 'Run: `'||trim(x)||'`'),
   list_transform(range(len({_ra(V.FACT_FILE_ROLE)})), lambda i: ({_ra(V.FACT_FILE_ROLE)})[i+1]||': '||trim(({_ra(V.FACT_FILE_ROLE, 2)})[i+1]))),
   list_concat(list_transform({_ra(V.FACT_CONVENTION)}, lambda x: 'Uses '||x), list_transform(range(len({_ra(V.FACT_RUNTIME)})), lambda i: ({_ra(V.FACT_RUNTIME)})[i+1]||' >= '||({_ra(V.FACT_RUNTIME, 2)})[i+1]))) AS ss
   FROM c WHERE length(c)>=80),
u AS (SELECT session_id, turn, unnest(ss)[1:400] AS statement, unnest(range(len(ss))) AS i FROM a),
v AS (SELECT * FROM u WHERE length(statement)>=10 AND ({S.first_rule('statement', V.LEAKAGE_EXTENDED)}) IS NULL
  QUALIFY row_number() OVER (PARTITION BY session_id, turn, regexp_replace(lower(statement),'\\s+',' ','g') ORDER BY i)=1)""", select=f"""
SELECT session_id, turn, row_number() OVER (PARTITION BY session_id, turn ORDER BY i)-1 AS pos, statement FROM v QUALIFY pos<{V.MAX_FACTS_PER_TURN}"""))

_q("b16_extract_pattern", lambda s, sf: M.extract_pattern(_pairs(s, sf)), S.with_(_PAIRS, f"""p0 AS (SELECT *, {_trim('user_text')} AS t FROM pr
  WHERE length(user_text)>={V.MIN_TASK_CHARS} AND length(assistant_text)>={V.MIN_OUTCOME_CHARS}),
p1 AS (SELECT *, {_trim("regexp_replace(" + _STRIP('assistant_text') + ", '\\n{3,}', chr(10)||chr(10), 'g')")} AS cl FROM p0 WHERE ({_PRUNE}) IS NULL),
p2 AS (SELECT *, list_filter(list_transform(string_split_regex(cl, '\\n{{2,}}'), lambda x: {_trim('x')}), lambda x: length(x)>=20) AS ps,
  list_transform(string_split(cl, chr(10)), lambda x: {_trim('x')}) AS ls FROM p1),
p3 AS (SELECT session_id, turn, {_trim("regexp_extract(t, '(?s)^.*?(?:[.!?]\\s|\\n{2,}|\\z)', 0)")}[1:{V.MAX_SITUATION}] AS situation, ps[1][1:600] AS mechanism,
  coalesce(list_filter(ls, lambda l: length(l)>={V.MIN_UNLOCK_CHARS} AND {S.rx('l', V.ACTION_LINE)})[1], ps[2])[1:600] AS unlock,
  coalesce(list_filter(ls, lambda l: length(l) BETWEEN 15 AND 600 AND {S.rx('l', V.VERIFICATION_LINE)})[1], {S.q(V.DEFAULT_VERIFICATION)})[1:600] AS verification FROM p2)""",
  select=f"SELECT * FROM p3 WHERE length(situation)>=20 AND length(mechanism)>={V.MIN_MECHANISM_CHARS} AND length(unlock)>={V.MIN_UNLOCK_CHARS}"))


def _steps(s, sf):
    t = D.turns(s, sf)
    kind = F.when(F.col("role") == "assistant", F.when(F.col("turn") % 4 == 3, "verification").otherwise("analysis")).when(F.col("role") == "user", "analysis").otherwise("action")
    n = F.substring("session_id", 2, 20).cast("bigint")
    desc = F.concat("content", F.when((n + F.col("turn")) % 3 == 0, F.lit(" But that didn't work.")).otherwise(F.lit("")))
    return t.select(F.col("session_id").alias("trace_id"), F.col("turn").alias("pos"), kind.alias("kind"), desc.alias("description"),
                    F.when(n % 3 == 0, "failure").otherwise("success").alias("outcome"))


_STEPS = """stp AS (SELECT 'c'||conv_id AS trace_id, turn AS pos, CASE WHEN role='assistant' THEN CASE WHEN turn%4=3 THEN 'verification' ELSE 'analysis' END WHEN role='user' THEN 'analysis' ELSE 'action' END AS kind,
  text||CASE WHEN (conv_id+turn)%3=0 THEN ' But that didn''t work.' ELSE '' END AS description, CASE WHEN conv_id%3=0 THEN 'failure' ELSE 'success' END AS outcome FROM conversations)"""
_q("b17_mine_trajectory", lambda s, sf: M.mine_trajectory(_steps(s, sf)).withColumn("dead_ends", F.array_join("dead_ends", " | ")), S.with_(_STEPS, f"""
ck AS (SELECT trace_id, any_value(outcome) AS outcome, max(pos) FILTER (kind='verification') AS cp FROM stp GROUP BY 1),
an AS (SELECT s.*, cp, ck.outcome AS o, lead(description) OVER (PARTITION BY s.trace_id ORDER BY pos) AS nx FROM stp s JOIN ck USING (trace_id) WHERE kind='analysis'),
un AS (SELECT trace_id, coalesce(arg_max(description, pos) FILTER (pos<cp), arg_max(description, pos)) AS u, arg_max(description, pos) AS f FROM an GROUP BY 1),
de AS (SELECT trace_id, pos, array_to_string(list_filter(string_split_regex({_trim('description')}, '\\s+'), lambda w: w<>'')[1:20], ' ') AS d FROM an WHERE nx IS NOT NULL AND {_any('nx', V.NEGATIVE_SIGNALS)}),
d2 AS (SELECT * FROM de WHERE d<>'' QUALIFY row_number() OVER (PARTITION BY trace_id, lower(d) ORDER BY pos)=1),
d3 AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY pos)<=5),
d4 AS (SELECT trace_id, string_agg(d, ' | ' ORDER BY pos) AS dead_ends FROM d3 GROUP BY 1)""", select="""
SELECT trace_id, CASE WHEN outcome='success' THEN u END AS unlock_step, CASE WHEN outcome='failure' THEN f END AS failure_step, coalesce(dead_ends,'') AS dead_ends
FROM ck LEFT JOIN un USING (trace_id) LEFT JOIN d4 USING (trace_id)"""))


def _checked(s, sf):
    b = _marked_blocks(s, sf).withColumn("dead_ends", F.split("mechanism", "\n")).withColumn("guardrails", F.slice(F.split("mechanism", r"\. "), 1, 4))
    return b.select("block_id", F.array_join(M.failed_checks(), ",").alias("failed"))


_nw = lambda c: f"len(list_filter(string_split_regex({_trim(c)}, '\\s+'), lambda w: w<>''))"
_BIG = "array_to_string([situation,mechanism,unlock,verification,array_to_string(dead_ends,chr(10)),array_to_string(guardrails,chr(10))],chr(10))"
_flds = ("situation", "mechanism", "unlock", "verification")
_q("b18_validate_blocks", _checked, S.with_(_MB, """v AS (SELECT *, string_split(mechanism, chr(10)) AS dead_ends, string_split(mechanism, '. ')[1:4] AS guardrails FROM mb)""",
   f"""l AS (SELECT *, {S.first_rule(_BIG, [*V.LEAKAGE_CORE, *V.LEAKAGE_EXTENDED])} AS leak FROM v)""", select=f"""
SELECT block_id, array_to_string(list_filter(list_concat(list_concat(['leakage:'||leak, {", ".join(f"CASE WHEN {_trim(f)}='' THEN 'schema:{f}-nonempty' END" for f in _flds)},
  {", ".join(f"CASE WHEN {_nw(f)}>{V.BLOCK_LIMITS[f]} THEN 'schema:{f}-length' END" for f in _flds)},
  CASE WHEN len(dead_ends) < CASE WHEN kind='pitfall' THEN 1 ELSE 0 END OR len(dead_ends)>5 THEN 'schema:dead-ends-count' END,
  CASE WHEN len(guardrails)>3 THEN 'schema:guardrails-count' END],
  list_transform(range(len(dead_ends)), lambda i: CASE WHEN {_nw('dead_ends[i+1]')}>20 THEN 'schema:dead-end-'||i||'-length' END)),
  list_transform(range(len(guardrails)), lambda i: CASE WHEN {_nw('guardrails[i+1]')}>20 THEN 'schema:guardrail-'||i||'-length' END)), lambda x: x IS NOT NULL), ',') AS failed FROM l"""))



def _kind():
    return F.element_at(F.array(F.lit("issue"), F.lit("check_run"), F.lit("pull_request")), (F.col("doc_id") % 3 + 1).cast("int"))


_q("b19_classify_failure", _docs(lambda t: [T.failure_class(t, _kind()).alias("failure_class")], marked=True), S.with_(S.MARKED, select=f"""
SELECT doc_id, coalesce({S.first_rule('text', V.FAILURE_CLASSES)}, CASE doc_id%3 WHEN 1 THEN 'ci-failure' WHEN 2 THEN 'code-change' ELSE 'general' END) AS failure_class FROM md"""))
_q("b20_infer_resolved", _docs(lambda t: [T.resolved_signal(t).alias("resolved")], marked=True), S.with_(S.MARKED, select=f"""
SELECT doc_id, length({_flat('text')})>=40 AND NOT {S.rx(_flat('text'), V.RESOLVED_NEGATIVE)} AND {S.rx(_flat('text'), V.RESOLVED_POSITIVE)} AS resolved FROM md"""))


def clamp_sql(c, n):
    head = f"({c})[1:{n}]"
    back = f"strpos(reverse({head}), ' ')"
    return (f"CASE WHEN length({c})<={n} THEN {c} WHEN {back}>0 AND {n}-{back}>{n}-80 THEN ({c})[1:({n}-{back})] || '…' ELSE {head} || '…' END")


_q("b21_estimate_tokens", _docs(lambda t: [T.estimate_tokens(t).alias("tokens"), T.clamp_text(t, 600).alias("clamped")]),
   f"SELECT doc_id, ceil(length(text)/4)::BIGINT AS tokens, {clamp_sql('text', 600)} AS clamped FROM documents")

_PATHS = ["src/{}/a.ts", "/repo/{}/b.py", "/etc/{}", "~/x/{}", "C:\\{}", "../{}", "a/../../{}", "./{}//c.go", "a/b/../{}.rs"]


def _paths(s, sf):
    t = D.documents(s, sf)
    made = [F.concat(F.lit(p.split("{}")[0]), F.col("source"), F.lit(p.split("{}")[1])) for p in _PATHS]
    path = F.element_at(F.array(*made, F.col("text")), (F.col("doc_id") % (len(made) + 1) + 1).cast("int"))
    return t.select("doc_id", path.alias("path"))


_PSQL = ", ".join(f"{S.q(p.split('{}')[0])}||source||{S.q(p.split('{}')[1])}" for p in _PATHS)
_q("b22_repo_relative", lambda s, sf: _paths(s, sf).select("doc_id", T.is_repo_relative(F.col("path")).alias("ok"), T.repo_relative(F.col("path"), "/repo").alias("rel")), S.with_(f"""
p AS (SELECT doc_id, ([{_PSQL}, text])[(doc_id%{len(_PATHS) + 1}+1)::INT] AS path0 FROM documents),
p1 AS (SELECT doc_id, {_trim('path0')} AS p, CASE WHEN starts_with({_trim('path0')},'/') THEN CASE WHEN starts_with({_trim('path0')},'/repo/') THEN ({_trim('path0')})[7:] END ELSE {_trim('path0')} END AS r FROM p),
s AS (SELECT doc_id, w, unnest(string_split(x,'/')) AS seg, unnest(range(len(string_split(x,'/')))) AS i FROM (SELECT doc_id, 'p' AS w, p AS x FROM p1 UNION ALL SELECT doc_id, 'r', r FROM p1)),
d AS (SELECT *, sum(CASE WHEN seg IN ('','.') THEN 0 WHEN seg='..' THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id, w ORDER BY i) AS depth FROM s),
m AS (SELECT doc_id, min(depth) FILTER (w='p') AS lp, min(depth) FILTER (w='r') AS lr FROM d GROUP BY 1)""", select="""
SELECT doc_id, length(p) BETWEEN 1 AND 256 AND NOT regexp_matches(p, '^/|^~|^[A-Za-z]:[\\\\/]') AND lp>=0 AS ok,
  CASE WHEN length(r) BETWEEN 1 AND 256 AND NOT regexp_matches(r, '^/|^~|^[A-Za-z]:[\\\\/]') AND lr>=0 THEN regexp_replace(regexp_replace(r, '(^|/)(\\./)+', '\\1', 'g'), '/+', '/', 'g') END AS rel
FROM p1 JOIN m USING (doc_id)"""))

_q("b23_expand_scope", lambda s, sf: D.facts(s, sf).select("fact_id", "scope", T.scope_specificity(F.col("scope")).alias("specificity"),
                                                        F.explode(T.expand_scope(F.col("scope"))).alias("visible")), S.with_(S.FACTS, """
e AS (SELECT fact_id, scope, unnest(list_distinct(list_concat(['global', scope], list_transform(list_filter(range(1, length(scope)+1), lambda i: scope[i] IN ('.','/') AND i>1), lambda i: scope[1:i-1])))) AS visible FROM fct WHERE scope<>'global'
  UNION ALL SELECT fact_id, scope, 'global' FROM fct WHERE scope='global')""", select="""
SELECT fact_id, scope, CASE WHEN scope='global' THEN 0 ELSE 1+length(regexp_replace(scope,'[^./]','','g')) END AS specificity, visible FROM e"""))

_q("f1_wilson_lower", lambda s, sf: D.table(s, sf, "labels").groupBy((F.col("doc_id") % 37).alias("grp")).agg(
    F.sum("quality").alias("successes"), F.count("*").alias("trials")).withColumn("wilson", scores.wilson_lower(F.col("successes"), F.col("trials"))),
   f"SELECT doc_id%37 AS grp, sum(quality)::BIGINT AS successes, count(*) AS trials, round({S.wilson('sum(quality)', 'count(*)')},6) AS wilson FROM labels GROUP BY 1")
_q("f10_holdout", _docs(lambda t: [scores.holdout(t, 0.25, "s").alias("held_out"), scores.holdout(t, 0.5, "rollout").alias("rollout_arm")]),
   f"SELECT doc_id, {S.holdout('text', 0.25, 's')} AS held_out, {S.holdout('text', 0.5, 'rollout')} AS rollout_arm FROM documents")
