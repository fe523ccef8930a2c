"""DuckDB SQL for the queries of ``catalog.py``, written against the shared views only."""

from __future__ import annotations

from logloom.functions import intents as I
from logloom.functions.text import EMAIL, PROVIDER_TOKEN, WS
from logloom.operators.privacy import PATH_RULES, REPOSITORY_RULES, SECRET_RULES
from logloom.plans.adapters import duckdb_views
from logloom.schema import USAGE_FIELDS

U = ", ".join(USAGE_FIELDS)
SUMS = ", ".join(f"CAST(coalesce(sum({f}), 0) AS BIGINT) AS {f}" for f in USAGE_FIELDS)
SUB = "(role = 'user' AND source_event IN ('event_msg.user_message', 'claude.user_message', 'cursor.user_message'))"
CSUB = "(provider = 'codex' AND role = 'user' AND source_event = 'event_msg.user_message')"
AUTO = "(source_event = 'event_msg.automation_message')"
KEYS = "file_path, timestamp, turn_id, input_tokens, cached_input_tokens, output_tokens, reasoning_output_tokens, total_tokens"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def norm(x: str) -> str:
    return f"lower({flat(x)})"


def jtrim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def ts(x: str) -> str:
    return f"try_cast({x} AS TIMESTAMP)"


def day(x: str = "timestamp") -> str:
    return f"coalesce(strftime({ts(x)}, '%Y-%m-%d'), 'unknown')"


def hour(x: str = "timestamp") -> str:
    return f"coalesce(strftime({ts(x)}, '%Y-%m-%d %H:00'), 'unknown')"


def ranged(x: str = "timestamp", low: str = "2024-01-05", high: str = "2024-01-20") -> str:
    return (f"coalesce({ts(x)} >= TIMESTAMP '{low} 00:00:00' AND {ts(x)} <= TIMESTAMP '{high} 23:59:59.999', true)")


def rx(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in patterns) + ")"


def project(cwd: str = "cwd", provider: str = "provider", aliases=()) -> str:
    named = " ".join("WHEN " + " OR ".join(f"contains({cwd}, {q(m)})" for m in ms) + f" THEN {q(n)}" for n, ms in aliases)
    alias = f"CASE {named} END" if named else "NULL"
    worktree = rf"nullif(regexp_extract({cwd}, '/\.codex/worktrees/[^/]+/([^/]+)$', 1), '')"
    return (f"CASE WHEN {cwd} IS NOT NULL THEN coalesce({alias}, {worktree}, regexp_extract({cwd}, '([^/]*)$', 1)) "
            f"WHEN {provider} = 'claude' THEN 'Claude Code' WHEN {provider} = 'cursor' THEN 'Cursor' ELSE 'Unknown Project' END")


def ctx(aliases=(), name: str = "ctx") -> str:
    return f"""{name} AS (SELECT k.file_path, k.session_id, coalesce(s.cwd, t.cwd) AS cwd, s.timestamp AS s_ts,
        s.title AS s_title, s.conv AS s_conv,
        {project('coalesce(s.cwd, t.cwd)', "coalesce(s.provider, t.provider, f.provider, 'codex')", aliases)} AS project
        FROM (SELECT file_path, session_id FROM lg_files UNION SELECT file_path, session_id FROM lg_sessions
              UNION SELECT file_path, session_id FROM lg_turns) k
        LEFT JOIN (SELECT file_path, session_id, first(cwd ORDER BY line) AS cwd, first(timestamp ORDER BY line) AS timestamp,
              first(title ORDER BY line) AS title, first(provider_conversation_id ORDER BY line) AS conv,
              first(provider ORDER BY line) AS provider FROM lg_sessions GROUP BY 1, 2) s USING (file_path, session_id)
        LEFT JOIN (SELECT file_path, session_id, first(cwd ORDER BY line) AS cwd, first(provider ORDER BY line) AS provider
              FROM lg_turns GROUP BY 1, 2) t USING (file_path, session_id)
        LEFT JOIN lg_files f USING (file_path, session_id))"""


TOK = f"tok AS (SELECT * FROM lg_usage QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY line) = 1)"
MODEL = ("tmodel AS (SELECT file_path, session_id, turn_id, last(coalesce(model, 'unknown') ORDER BY line) AS model "
         "FROM lg_turns GROUP BY 1, 2, 3)")


def intent(src: str, content: str = "content", out: str = "ci") -> str:
    """CTEs that add literal, rule_no and the rule's attributes to a relation."""
    strong = [p.replace("{app_names}", "|".join(I.APP_NAMES)) for p in I.STRONG_FEATURE]
    bare = rf"trim(regexp_replace(regexp_replace(literal, '[.!]+$', ''), '{WS}*,{WS}*', ', ', 'g'))"
    tests = [
        f"length(literal) <= {I.APPROVAL_LIMIT} AND {rx(bare, I.APPROVAL)}",
        f"NOT {rx('command', [I.RELEASE_NOTES])} AND {rx('command', I.DEPLOY)}",
        rx("command", I.GIT), rx("command", I.RUN_BUILD), rx("command", I.REVIEW), rx("m", I.TESTING),
        rx("m", I.DOCUMENTATION), f"{rx('literal', I.DIRECT_FIX)} OR {rx('command', I.DIRECT_FIX)}",
        f"{rx('m', I.BUG)} AND {rx('m', strong)}", rx("m", I.BUG), rx("m", I.PLANNING), rx("m", I.DATA),
        rx("m", I.CONTENT), rx("m", strong), rx("m", I.CLEANUP), rx("m", I.DESIGN), rx("m", I.IMPLEMENTATION),
        rx("m", I.RESEARCH), rx("m", I.CONTEXT), rx("m", I.BROAD_ACTION), "literal <> ''",
    ]
    case = "CASE " + " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(tests, 1)) + f" ELSE {len(I.RULES)} END"

    def pick(values: list[str]) -> str:
        return "([" + ", ".join(q(v) for v in values) + "])[rule_no]"

    signals = pick(["|".join(r[4]) for r in I.RULES])
    return f"""{out}_1 AS (SELECT *, {norm(content)} AS literal FROM {src}),
    {out}_2 AS (SELECT *, trim(regexp_replace(regexp_replace(literal, {q(I.COURTESY)}, ''), {q(I.TRAILING_COURTESY)}, '')) AS command
        FROM {out}_1),
    {out}_3 AS (SELECT *, CASE WHEN command = literal THEN literal ELSE literal || ' ' || command END AS m FROM {out}_2),
    {out}_4 AS (SELECT *, {case} AS rule_no FROM {out}_3),
    {out}_5 AS (SELECT *, {pick([r[0] for r in I.RULES])} AS rule_key, {pick([r[2] for r in I.RULES])} AS rule_label,
        {pick([r[3] for r in I.RULES])} AS confidence, {pick([r[1] for r in I.RULES])} AS intent_key,
        {pick([I.CATEGORIES[r[1]] for r in I.RULES])} AS intent_label,
        {signals} || CASE WHEN command <> literal AND rule_no <= {len(I.RULES) - 2} THEN '|normalized-command' ELSE '' END
        AS signals FROM {out}_4),
    {out} AS (SELECT *, CASE WHEN intent_key IN ({', '.join(q(k) for k in I.OPERATIONAL)}) THEN intent_label END AS category,
        CASE WHEN intent_key IN ({', '.join(q(k) for k in I.OPERATIONAL)}) THEN 'category:' || intent_key ELSE literal END
        AS group_key, CASE WHEN length({flat(content)}) > 240 THEN substr({flat(content)}, 1, 237) || '...'
        ELSE {flat(content)} END AS variant_sample FROM {out}_5)"""


def label(key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in I.CATEGORIES.items()) + f" ELSE {key} END"


PROMPTS = f"sub AS (SELECT * FROM lg_messages WHERE {SUB}), " + intent("sub")
CODEX = f"cod AS (SELECT * FROM lg_messages WHERE {CSUB}), " + intent("cod")


def buckets(key) -> str:
    return f"""{PROMPTS}, {TOK}, mb AS (SELECT {key()} AS bucket, count(*) AS messages, count(DISTINCT group_key) AS unique_messages
        FROM ci GROUP BY 1), tb AS (SELECT {key()} AS bucket, {SUMS} FROM tok GROUP BY 1),
    bk AS (SELECT coalesce(mb.bucket, tb.bucket) AS bucket, coalesce(messages, 0) AS messages,
        coalesce(unique_messages, 0) AS unique_messages, {', '.join(f'coalesce({f}, 0) AS {f}' for f in USAGE_FIELDS)}
        FROM mb FULL JOIN tb ON mb.bucket = tb.bucket)"""


SESSION_DAYS = f"""{ctx()}, own AS (SELECT DISTINCT file_path, session_id FROM lg_files),
    stok AS (SELECT * FROM lg_usage QUALIFY row_number() OVER (PARTITION BY {KEYS}, session_id ORDER BY line) = 1),
    acts AS (SELECT file_path, session_id, {day()} AS date_key, timestamp AS t, CAST({SUB} AS INT) AS p, CAST({AUTO} AS INT) AS a,
        CAST(role = 'assistant' AS INT) AS r, 0 AS k FROM lg_messages
      UNION ALL SELECT file_path, session_id, {day()}, timestamp, 0, 0, 0, total_tokens FROM stok
      UNION ALL SELECT file_path, session_id, {day()}, timestamp, 0, 0, 0, 0 FROM lg_turns
      UNION ALL SELECT file_path, session_id, {day('s_ts')}, s_ts, 0, 0, 0, 0 FROM ctx WHERE s_ts IS NOT NULL),
    sl AS (SELECT file_path, session_id, date_key, min(t) AS first_seen, max(t) AS last_seen, CAST(sum(p) AS BIGINT) AS user_messages,
        CAST(sum(a) AS BIGINT) AS automation_messages, CAST(sum(r) AS BIGINT) AS assistant_messages,
        CAST(sum(k) AS BIGINT) AS total_tokens FROM acts SEMI JOIN own USING (file_path, session_id) GROUP BY 1, 2, 3),
    md AS (SELECT file_path, session_id, {day()} AS date_key, model, min(line) AS line FROM lg_turns WHERE model <> ''
        GROUP BY 1, 2, 3, 4),
    sd AS (SELECT f.provider, f.source_label, coalesce(f.title, s_title) AS title,
        coalesce(f.provider_conversation_id, s_conv) AS provider_conversation_id, sl.file_path, sl.session_id, sl.date_key, project,
        cwd, first_seen, last_seen, user_messages, automation_messages, assistant_messages, total_tokens,
        coalesce((SELECT string_agg(model, '|' ORDER BY line, model) FROM md WHERE md.file_path = sl.file_path
          AND md.session_id = sl.session_id AND md.date_key = sl.date_key), '') AS models
        FROM sl JOIN lg_files f USING (file_path, session_id) LEFT JOIN ctx USING (file_path, session_id) WHERE user_messages > 0)"""

PROJECTS = f"""{ctx()}, pf AS (SELECT file_path, min(t) AS f, max(t) AS l, sum(n_turns) AS n_turns, sum(n_prompts) AS n_prompts,
        sum(n_tokens) AS n_tokens, count(DISTINCT d) AS n_sessions FROM (
        SELECT file_path, timestamp AS t, 0 AS n_turns, 0 AS n_prompts, 0 AS n_tokens, NULL AS d FROM lg_sessions
        UNION ALL SELECT file_path, timestamp, 1, 0, 0, NULL FROM lg_turns
        UNION ALL SELECT file_path, timestamp, 0, CAST({SUB} AS INT), 0, CASE WHEN {SUB} THEN {day()} END FROM lg_messages
        UNION ALL SELECT file_path, timestamp, 0, 0, total_tokens, NULL FROM lg_usage) GROUP BY 1),
    fs AS (SELECT fl.*, c.project, c.cwd, pf.* EXCLUDE (file_path) FROM lg_files fl JOIN ctx c USING (file_path, session_id)
        LEFT JOIN pf ON pf.file_path = fl.file_path),
    cs AS (SELECT project, cwd, min(file_path) AS pos FROM fs WHERE cwd IS NOT NULL GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY project ORDER BY min(file_path), cwd) <= 5),
    pj AS (SELECT project, string_agg(DISTINCT provider, '|' ORDER BY provider) AS providers,
        coalesce((SELECT string_agg(cwd, '|' ORDER BY pos, cwd) FROM cs WHERE cs.project = fs.project), '') AS cwd_samples,
        CAST(coalesce(sum(n_sessions), 0) AS BIGINT) AS sessions, CAST(coalesce(sum(n_turns), 0) AS BIGINT) AS turns,
        CAST(coalesce(sum(n_prompts), 0) AS BIGINT) AS messages, CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS total_tokens,
        min(f) AS first_seen, max(l) AS last_seen FROM fs GROUP BY project)"""

REPEATED = f"""{CODEX}, rg AS (SELECT substr(sha256(group_key), 1, 16) AS id, group_key,
        first(coalesce(category, variant_sample) ORDER BY file_path, line) AS sample, any_value(category) AS category,
        count(*) AS count, count(DISTINCT file_path || chr(10) || session_id) AS session_count, min(timestamp) AS first_seen,
        max(timestamp) AS last_seen FROM ci WHERE literal <> '' GROUP BY group_key HAVING count(*) > 1)"""


def share(src: str) -> str:
    return f"floor(count / (SELECT sum(count) FROM {src}) * 1000 + 0.5) / 10 AS percentage"


INTENTS = f"""{CODEX}, {ctx()}, ex AS (SELECT *, CASE WHEN length({flat('content')}) > 96 THEN substr({flat('content')}, 1, 93) || '...'
        ELSE {flat('content')} END AS example FROM ci),
    e3 AS (SELECT intent_key, first(example ORDER BY file_path, line) AS example, min(file_path || lpad(CAST(line AS VARCHAR), 9, '0'))
        AS pos FROM ex WHERE example <> '' GROUP BY intent_key, {norm('example')}
        QUALIFY row_number() OVER (PARTITION BY intent_key ORDER BY pos) <= 3),
    ib AS (SELECT intent_key, any_value(intent_label) AS label, count(*) AS count,
        count(DISTINCT file_path || chr(10) || session_id) AS session_count, count(DISTINCT project) AS project_count,
        (SELECT string_agg(example, '|' ORDER BY pos) FROM e3 WHERE e3.intent_key = ci.intent_key) AS examples,
        min(ci.timestamp) AS first_seen, max(ci.timestamp) AS last_seen FROM ci LEFT JOIN ctx USING (file_path, session_id)
        GROUP BY intent_key)"""


def totals(where: str = "true", scope: str = "true", paths: str = "true", sd_where: str = "true", warn: str = "true") -> str:
    def n(t: str) -> str:
        return f"(SELECT count(*) FROM {t} WHERE {where} AND {paths})"

    return f"""SELECT (SELECT count(*) FROM sd WHERE {sd_where}) AS sessions, {n('lg_turns')} AS turns,
        (SELECT count(*) FROM ci WHERE {where} AND {paths}) AS user_messages,
        (SELECT count(*) FROM lg_messages WHERE {AUTO} AND {where} AND {paths}) AS automation_messages,
        (SELECT count(*) FROM lg_messages WHERE role = 'assistant' AND {where} AND {paths}) AS assistant_messages,
        (SELECT count(DISTINCT group_key) FROM ci WHERE {where} AND {paths}) AS unique_user_messages,
        {n('lg_tools')} AS tool_events, {n('lg_unknown')} AS unknown_events,
        (SELECT count(*) FROM lg_warnings WHERE {warn}) AS parse_warnings"""


WARN_FILES = f"""recs AS (SELECT file_path, session_id, timestamp FROM lg_sessions UNION ALL
        SELECT file_path, session_id, timestamp FROM lg_messages UNION ALL SELECT file_path, session_id, timestamp FROM lg_turns
        UNION ALL SELECT file_path, session_id, timestamp FROM lg_usage UNION ALL
        SELECT file_path, session_id, timestamp FROM lg_tools UNION ALL SELECT file_path, session_id, timestamp FROM lg_unknown),
    wf AS (SELECT f.file_path FROM lg_files f LEFT JOIN (SELECT file_path, session_id, bool_or({ranged()}) AS act,
        bool_or(timestamp IS NOT NULL) AS dated FROM recs GROUP BY 1, 2) r USING (file_path, session_id)
        WHERE coalesce(act, false) OR NOT coalesce(dated, false))"""

# session slices inside the date range: the same query over range-filtered records
RANGED_DAYS = SESSION_DAYS.replace("FROM lg_messages", f"FROM (SELECT * FROM lg_messages WHERE {ranged()})").replace(
    "FROM lg_usage QUALIFY", f"FROM (SELECT * FROM lg_usage WHERE {ranged()}) QUALIFY").replace(
    "0, 0, 0, 0 FROM lg_turns", f"0, 0, 0, 0 FROM (SELECT * FROM lg_turns WHERE {ranged()})").replace(
    "WHERE s_ts IS NOT NULL", f"WHERE s_ts IS NOT NULL AND {ranged('s_ts')}")

# message boundaries of interactions
EVENTS = f"""ev AS (SELECT file_path, session_id, line, seq, 0 AS rk, CASE WHEN {SUB} THEN 'prompt' WHEN {AUTO} THEN 'automation'
        WHEN role = 'assistant' THEN 'assistant' ELSE 'context' END AS kind, turn_id, timestamp, content,
        CASE WHEN {jtrim('content')} = '' THEN source_event ELSE {jtrim('content')} END AS display, 0 AS total_tokens FROM lg_messages
      UNION ALL SELECT file_path, session_id, line, seq, 1, 'tool', turn_id, timestamp, content, NULL, 0 FROM lg_tools
      UNION ALL SELECT file_path, session_id, line, 0, 2, 'tokens', turn_id, timestamp, NULL, NULL, total_tokens FROM lg_usage),
    bd AS (SELECT file_path, session_id, line, kind FROM ev WHERE kind IN ('prompt', 'automation')),
    ir_1 AS (SELECT ev.*, bd.line AS prompt_line, bd.kind AS opener FROM ev ASOF JOIN bd ON ev.file_path = bd.file_path
        AND ev.session_id = bd.session_id AND ev.line >= bd.line),
    ir AS (SELECT * FROM ir_1 WHERE opener = 'prompt' AND (line > prompt_line OR kind = 'prompt')
        QUALIFY kind NOT IN ('assistant', 'context') OR
        row_number() OVER (PARTITION BY file_path, session_id, prompt_line, kind, display ORDER BY line, seq) = 1)"""

AUDIT_PARTS = """am AS (SELECT *, {sub} AS is_p, {sub} AND {rng} AS wanted FROM lg_messages),
    an AS (SELECT *, sum(CAST(is_p AS INT)) OVER w AS bno, sum(CAST(wanted AS INT)) OVER w AS prompt_no FROM am
        WINDOW w AS (PARTITION BY file_path, session_id ORDER BY line, coalesce(timestamp, ''), source_event, seq)),
    op AS (SELECT file_path, session_id, bno FROM an WHERE wanted),
    ap AS (SELECT an.*, CASE WHEN is_p THEN 'prompt' ELSE 'response' END AS kind FROM an SEMI JOIN op USING (file_path, session_id, bno)
        SEMI JOIN lg_files USING (file_path, session_id)
        WHERE wanted OR (role = 'assistant' AND {blank} <> ''))"""


def audit_parts(rng: str) -> str:
    return AUDIT_PARTS.format(sub=SUB, rng=rng, blank=jtrim("content"))


EVAL_ID = ("substr(sha256(concat_ws(chr(0), file_path, session_id, CAST(line AS VARCHAR), coalesce(turn_id, ''), "
           "coalesce(timestamp, ''), content)), 1, 24)")
REVIEWS = f"""rv AS (SELECT {EVAL_ID} AS eval_id, 'other' AS actual_key,
        (['git-commands', 'feedback-context', 'bug-fixes', 'research'])[length(content) % 4 + 1] AS expected_key, false AS is_correct,
        timestamp AS reviewed_at, CAST(NULL AS VARCHAR) AS note FROM lg_messages
        WHERE source_event = 'event_msg.user_message' AND length(content) % 3 <> 0)"""


def eval_rows(where: str = "true") -> str:
    return f"""cod AS (SELECT * FROM lg_messages WHERE source_event = 'event_msg.user_message' AND {where}), {intent('cod')}, {ctx()}, {REVIEWS},
    em AS (SELECT {EVAL_ID} AS eval_id, ci.*, {day('ci.timestamp')} AS date_key, coalesce(project, 'Unknown Project') AS project, cwd
        FROM ci LEFT JOIN ctx USING (file_path, session_id)),
    er AS (SELECT em.*, rv.eval_id IS NOT NULL AS reviewed, rv.expected_key, rv.expected_key = intent_key AS is_correct,
        rv.reviewed_at FROM em LEFT JOIN rv USING (eval_id))"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN floor({a} / {b} * 1000 + 0.5) / 1000 END"


EVAL_SUMMARY = f"""pr AS (SELECT intent_key AS key, count(*) AS total, count_if(reviewed) AS reviewed, count_if(is_correct) AS correct,
        count_if(NOT is_correct) AS incorrect, count_if(NOT reviewed) AS unreviewed FROM er GROUP BY 1),
    xp AS (SELECT expected_key AS key, count(*) AS e_reviewed, count_if(is_correct) AS e_correct FROM er WHERE reviewed GROUP BY 1),
    es AS (SELECT coalesce(pr.key, xp.key) AS key, coalesce(total, 0) AS total, coalesce(reviewed, 0) AS reviewed,
        coalesce(correct, 0) AS correct, coalesce(incorrect, 0) AS incorrect, coalesce(unreviewed, 0) AS unreviewed,
        coalesce(e_reviewed, 0) AS e_reviewed, coalesce(e_correct, 0) AS e_correct FROM pr FULL JOIN xp ON pr.key = xp.key)"""

GOLD = intent("lg_gold", "message", "gi")


def search_where(extra: str) -> str:
    return f"""{ctx()}, {MODEL}, mi AS (SELECT * FROM lg_messages), {intent('mi')},
    ma AS (SELECT ci.*, ctx.project, ctx.cwd, tmodel.model, {CSUB} AS cs FROM ci LEFT JOIN ctx USING (file_path, session_id)
        LEFT JOIN tmodel ON tmodel.file_path = ci.file_path AND tmodel.session_id = ci.session_id AND tmodel.turn_id = ci.turn_id),
    hits AS (SELECT *, row_number() OVER (ORDER BY file_path, line, seq, session_id) - 1 AS match_index FROM ma WHERE {extra})"""


SEARCH_COLUMNS = f"""concat_ws('#', file_path, session_id, CAST(line AS VARCHAR), coalesce(turn_id, ''), coalesce(timestamp, ''), role,
        source_event, CAST(match_index AS VARCHAR)) AS id, provider, file_path, session_id, {day()} AS date_key, project, cwd, line,
        turn_id, CASE WHEN turn_id IS NOT NULL THEN model END AS model, timestamp, role, source_event,
        CASE WHEN cs THEN category END AS category, CASE WHEN cs THEN intent_key END AS intent_key,
        CASE WHEN cs THEN intent_label END AS intent_label"""
SNIP = f"""CASE WHEN start > 0 THEN '...' ELSE '' END || substr(tr, start + 1, 240) ||
        CASE WHEN start + 240 < length(tr) THEN '...' ELSE '' END AS snippet"""


def rollout(cols: str, where: str, offset: int) -> str:
    """Expected rows of the rebuilt rollout files: one of five lines per conversation row."""
    return f"""ln AS (SELECT *, '/r/rollout-c' || conv_id || '.jsonl' AS file_path, turn * 5 + {offset} AS line,
        CASE WHEN min(turn) OVER (PARTITION BY conv_id) = 0 THEN session_id ELSE 'c' || conv_id END AS sid,
        't' || turn_no AS tid FROM lg_conv) SELECT file_path, sid AS session_id, line, {cols} FROM ln WHERE {where}"""


DOCS = "d AS (SELECT doc_id, source, text FROM documents)"


def secret_hits(keys: str) -> str:
    def plain(p: str, i: bool) -> str:
        p = p.replace(r"(?!\[redacted\])", "").replace("(?!example/)", "")
        p = p.replace(r'[^\s`",}]', f'[^{WS[1:-1]}`",}}]').replace(r"[-.\s]", f"[-.{WS[1:-1]}]").replace(r"\s", WS)
        return ("(?i)" if i else "") + p

    parts = []
    for name, p, i in SECRET_RULES:
        hits = f"len(regexp_extract_all(text, {q(plain(p, i))}))"
        if "example" in p:
            hits += " - len(regexp_extract_all(text, '/Users/example/'))"
        parts.append(f"SELECT {keys}, {q(name)} AS rule, {hits} AS hits FROM d")
    return f"{DOCS}, sh AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE hits > 0)"


def redact(x: str) -> str:
    pair = rf"""(?i)\b(password|api[_-]?key|token|secret){WS}*[:=]{WS}*("[^"]*"|'[^']*'|[^{WS[1:-1]}`]+)"""
    out = f"regexp_replace({x}, {q('/Users/[^/' + WS[1:-1] + '`]+')}, '~', 'g')"
    out = f"regexp_replace({out}, {q('(?i)' + EMAIL)}, '[redacted-email]', 'g')"
    out = f"regexp_replace({out}, {q(PROVIDER_TOKEN)}, '[redacted-token]', 'g')"
    return f"regexp_replace({out}, {q(pair)}, {q(chr(92) + '1=[redacted-secret]')}, 'g')"


SQL: dict[str, tuple[str, str]] = {}


def add(name: str, ctes: str, select: str) -> None:
    SQL[name] = (ctes, select)


add("token_totals", TOK, f"SELECT {SUMS} FROM tok")
add("tokens_by_day", TOK, f"SELECT {day()} AS bucket, {SUMS} FROM tok GROUP BY 1")
add("tokens_by_hour", TOK, f"SELECT {hour()} AS bucket, {SUMS} FROM tok GROUP BY 1")
add("dedupe_token_events", TOK, "SELECT file_path, session_id, line, fresh_input_tokens, total_tokens FROM tok")
add("model_usage", f"""{TOK}, {MODEL}, a AS (SELECT coalesce(model, 'unknown') AS model, count(*) AS turns FROM lg_turns GROUP BY 1),
    b AS (SELECT coalesce(tmodel.model, 'unknown') AS model, {SUMS} FROM tok LEFT JOIN tmodel USING (file_path, session_id, turn_id)
        GROUP BY 1)""",
    f"""SELECT coalesce(a.model, b.model) AS model, coalesce(turns, 0) AS turns,
    {', '.join(f'coalesce({f}, 0) AS {f}' for f in USAGE_FIELDS)} FROM a FULL JOIN b ON a.model = b.model""")
add("provider_usage", TOK, f"""SELECT p.provider, coalesce(sessions, 0) AS sessions, coalesce(messages, 0) AS messages,
    CAST(coalesce(total_tokens, 0) AS BIGINT) AS total_tokens FROM (SELECT DISTINCT provider FROM lg_files) p
    LEFT JOIN (SELECT provider, count(*) AS messages, count(DISTINCT file_path || session_id || '#' || {day()}) AS sessions
        FROM lg_messages WHERE {SUB} GROUP BY 1) m USING (provider)
    LEFT JOIN (SELECT provider, sum(total_tokens) AS total_tokens FROM tok GROUP BY 1) t USING (provider)""")
add("messages_by_day", buckets(day), "SELECT * FROM bk")
add("messages_by_hour", buckets(hour), "SELECT * FROM bk")
for _n, _v in (("hour_of_day", "messages"), ("hour_of_day_output", "output_tokens")):
    add(_n, buckets(hour), f"""SELECT CAST(h.range AS INT) AS hour, CAST(coalesce(n, 0) AS BIGINT) AS count FROM range(24) h LEFT JOIN
    (SELECT CAST(substr(bucket, 12, 2) AS INT) AS hour, sum({_v}) AS n FROM bk WHERE bucket <> 'unknown' GROUP BY 1) x ON h.range = x.hour""")
add("hour_of_day_tokens", buckets(hour), """SELECT hour, kind, CAST(value AS BIGINT) AS value FROM (
    SELECT CAST(substr(bucket, 12, 2) AS INT) AS hour, 'Input' AS kind, sum(input_tokens) AS value FROM bk WHERE bucket <> 'unknown' GROUP BY 1
    UNION ALL SELECT CAST(substr(bucket, 12, 2) AS INT), 'Output', sum(output_tokens) FROM bk WHERE bucket <> 'unknown' GROUP BY 1)
    WHERE value > 0""")
add("weekday", buckets(day), """SELECT CAST(w.range AS INT) AS weekday, CAST(coalesce(n, 0) AS BIGINT) AS count FROM range(1, 8) w LEFT JOIN
    (SELECT dayofweek(CAST(bucket AS DATE)) + 1 AS weekday, sum(messages) AS n FROM bk WHERE bucket <> 'unknown' GROUP BY 1) x
    ON w.range = x.weekday""")
add("turn_model_of_messages", MODEL, """SELECT m.file_path, m.session_id, m.line, m.turn_id, t.model FROM lg_messages m
    LEFT JOIN tmodel t ON t.file_path = m.file_path AND t.session_id = m.session_id AND t.turn_id = m.turn_id""")

add("summary_totals", f"{PROMPTS}, {SESSION_DAYS}", totals(
    warn="file_path IN (SELECT file_path FROM lg_files)", paths="file_path IN (SELECT file_path FROM lg_files)"))
_codex = "file_path IN (SELECT file_path FROM lg_files WHERE provider = 'codex')"
add("summary_totals_scoped", f"{PROMPTS}, {RANGED_DAYS}, {WARN_FILES}", totals(
    where=ranged(), paths=_codex, sd_where="provider = 'codex'",
    warn=f"file_path IN (SELECT file_path FROM wf) AND {_codex}"))
add("session_days", SESSION_DAYS, "SELECT * FROM sd")
add("activity_range", SESSION_DAYS, "SELECT min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM sd")
add("redact_summary", SESSION_DAYS, """SELECT session_id, date_key, CASE WHEN title <> '' THEN '[redacted]' END AS title,
    CASE WHEN provider_conversation_id <> '' THEN '[redacted]' END AS provider_conversation_id, '[redacted]' AS file_path,
    CASE WHEN cwd <> '' THEN '[redacted]' END AS cwd, user_messages FROM sd""")
add("list_projects", PROJECTS, "SELECT * FROM pj")
add("projects_total", PROJECTS, """SELECT CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(messages) AS BIGINT) AS messages,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens, max(last_seen) AS last_seen FROM pj""")
add("session_spans", f"""{ctx()}, sp AS (SELECT file_path, min(a) AS first_seen, max(b) AS last_seen FROM (
      SELECT file_path, timestamp AS a, timestamp AS b FROM lg_sessions UNION ALL SELECT file_path, timestamp, timestamp FROM lg_turns
      UNION ALL SELECT file_path, timestamp, timestamp FROM lg_messages UNION ALL SELECT file_path, NULL, timestamp FROM lg_usage) GROUP BY 1)""",
    """SELECT file_path || '#' || session_id AS id, f.file_path, session_id, project, cwd, first_seen, last_seen, line_count,
    (SELECT count(*) FROM lg_tools x WHERE x.file_path = f.file_path) AS tool_events,
    (SELECT count(*) FROM lg_unknown x WHERE x.file_path = f.file_path) AS unknown_events,
    (SELECT count(*) FROM lg_warnings x WHERE x.file_path = f.file_path) AS warnings
    FROM lg_files f JOIN ctx USING (file_path, session_id) LEFT JOIN sp ON sp.file_path = f.file_path""")
_limbs = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT) AS s{i}" for i in range(8))
add("corpus_fingerprint", f"""fp AS (SELECT sha256(concat_ws(chr(0), f.file_path, provider, session_id, CAST(line_count AS VARCHAR),
      CAST((SELECT count(*) FROM lg_messages x WHERE x.file_path = f.file_path) AS VARCHAR),
      CAST((SELECT count(*) FROM lg_turns x WHERE x.file_path = f.file_path) AS VARCHAR),
      CAST((SELECT count(*) FROM lg_usage x WHERE x.file_path = f.file_path) AS VARCHAR),
      coalesce((SELECT max(timestamp) FROM lg_messages x WHERE x.file_path = f.file_path), ''))) AS h FROM lg_files f),
    fq AS (SELECT count(*) AS files, {_limbs} FROM fp)""",
    f"SELECT files, sha256(concat_ws(':', files, {', '.join(f's{i}' for i in range(8))})) AS fingerprint FROM fq")
add("sessions_by_id", "x AS (SELECT 1)", """SELECT session_id, file_path, timestamp, cwd FROM lg_sessions
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY file_path DESC, line DESC) = 1""")
add("project_name", ctx(), "SELECT file_path, session_id, cwd, project FROM ctx")
add("alias_match", ctx((("Tools", ("team-tools", "nothing")), ("Home A", ("proj-a",)), ("Late", ("/home/dev/",)))),
    "SELECT file_path, session_id, cwd, project FROM ctx")
_single = ["sessions", "turns", "user_messages", "automation_messages", "assistant_messages", "unique_user_messages"]
_tokens = ["input_tokens", "cached_input_tokens", "fresh_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
add("metrics_long", f"{PROMPTS}, {SESSION_DAYS.replace(ctx() + ',', ctx() + ',', 1)}, {TOK}, "
    + REPEATED.replace("ci", "cj").replace("cod AS", "cod2 AS").replace("FROM cod)", "FROM cod2)").replace("FROM cod,", "FROM cod2,")
    .replace("FROM cod\n", "FROM cod2\n").replace("FROM cod ", "FROM cod2 ")
    + f""", tt AS ({totals()}), tk AS (SELECT {SUMS} FROM tok),
    pv AS (SELECT p.provider, coalesce(messages, 0) AS messages, coalesce(sessions, 0) AS sessions FROM
      (SELECT DISTINCT provider FROM lg_files) p LEFT JOIN (SELECT provider, count(*) AS messages,
      count(DISTINCT file_path || session_id || '#' || {day()}) AS sessions FROM lg_messages WHERE {SUB} GROUP BY 1) m USING (provider))""",
    "SELECT 'project' AS metric, 'All Projects' AS value UNION ALL "
    + " UNION ALL ".join(f"SELECT {q(n)}, CAST({n} AS VARCHAR) FROM tt" for n in [*_single, "unknown_events", "parse_warnings"])
    + " UNION ALL " + " UNION ALL ".join(f"SELECT {q(n)}, CAST({n} AS VARCHAR) FROM tk" for n in _tokens)
    + """ UNION ALL SELECT 'repeated_user_messages', CAST(least(10, count(*)) AS VARCHAR) FROM rg
    UNION ALL SELECT 'repeated_user_message_groups', CAST(count(*) AS VARCHAR) FROM rg
    UNION ALL SELECT 'providers', string_agg(provider, '|' ORDER BY messages DESC, provider) FROM pv
    UNION ALL SELECT 'prompt_intent_classified_messages', CAST(count_if(intent_key <> 'other') AS VARCHAR) FROM cj
    UNION ALL SELECT 'prompt_intent_unclassified_messages', CAST(count_if(intent_key = 'other') AS VARCHAR) FROM cj
    UNION ALL SELECT 'prompt_intent_' || intent_key, CAST(count(*) AS VARCHAR) FROM cj GROUP BY intent_key
    UNION ALL SELECT 'provider_' || provider || '_messages', CAST(messages AS VARCHAR) FROM pv
    UNION ALL SELECT 'provider_' || provider || '_sessions', CAST(sessions AS VARCHAR) FROM pv""")
add("report_parity", f"""{TOK}, a AS (SELECT {day()} AS d, CAST(sum(total_tokens) AS DOUBLE) AS actual FROM tok GROUP BY 1),
    r AS (SELECT substr(timestamp, 1, 10) AS d, CAST(sum(total_tokens) AS DOUBLE) AS expected FROM lg_usage GROUP BY 1)""",
    """SELECT 'tokens_by_day.' || d AS metric, expected, actual, abs(actual - expected) AS delta FROM r LEFT JOIN a USING (d)
    WHERE actual IS NULL OR abs(actual - expected) > greatest(1.0, expected * 0.09)""")

add("date_range", "x AS (SELECT 1)", f"SELECT role, count(*) AS n FROM lg_messages WHERE {ranged()} GROUP BY 1")
_bounds = {"day": ("2024-01-17", "2024-01-17"), "week": ("2024-01-14", "2024-01-20"), "month": ("2024-01-01", "2024-01-24"),
           "year": ("2024-01-01", "2024-01-24"), "custom": ("2024-01-09", "2024-01-09")}
add("date_preset", "x AS (SELECT 1)", "SELECT 'all' AS mode, count(*) AS n FROM lg_messages UNION ALL " + " UNION ALL ".join(
    f"SELECT {q(m)}, count(*) FROM lg_messages WHERE {ranged('timestamp', a, b)}" for m, (a, b) in _bounds.items()))
add("last_n_days", "dm AS (SELECT * FROM lg_messages)", f"""SELECT role, count(*) AS n FROM dm
    WHERE {ts('timestamp')} >= (SELECT max({ts('timestamp')}) - INTERVAL 7 DAY FROM dm) GROUP BY 1""")
add("warnings_in_scope", WARN_FILES, "SELECT file_path, line, code FROM lg_warnings SEMI JOIN wf USING (file_path)")
add("project_scope", f"{ctx()}, vf AS (SELECT f.* FROM lg_files f JOIN ctx USING (file_path, session_id) WHERE project = 'proj-a')",
    "SELECT 'files' AS name, count(*) AS n FROM vf UNION ALL " + " UNION ALL ".join(
        f"SELECT {q(n)}, count(*) FROM {t} SEMI JOIN vf USING (file_path)" for n, t in (
            ("messages", "lg_messages"), ("turns", "lg_turns"), ("token_usage", "lg_usage"), ("tool_events", "lg_tools"),
            ("unknown_events", "lg_unknown"), ("warnings", "lg_warnings"))))
add("repo_scope", ctx(), """SELECT file_path, session_id FROM ctx WHERE
    CASE WHEN cwd IS NULL THEN project IN ('proj-b', 'team-tools') ELSE cwd = '/srv/checkout/team-tools'
      OR starts_with(cwd, '/srv/checkout/team-tools/') OR starts_with(cwd, '/work/other/proj-b')
      OR (contains(cwd, '/.codex/worktrees/') AND project IN ('proj-b', 'team-tools')) END""")
add("visible_session", "x AS (SELECT 1)", """SELECT file_path, session_id, line_count FROM lg_files WHERE session_id = 'sx7'""")
add("session_detail", f"sm AS (SELECT * FROM lg_messages WHERE file_path = '/logs/c3.jsonl'), {intent('sm')}",
    f"""SELECT file_path, session_id, line, role, CASE WHEN {CSUB} THEN category END AS category,
    CASE WHEN {CSUB} THEN intent_key END AS intent_key, CASE WHEN {CSUB} THEN intent_label END AS intent_label FROM ci""")
add("automation_messages", "x AS (SELECT 1)", f"SELECT file_path, session_id, line, timestamp FROM lg_messages WHERE {AUTO}")
add("hidden_category", f"am AS (SELECT * FROM lg_messages), {intent('am')}, ca AS (SELECT CASE WHEN {CSUB} THEN category END AS category FROM ci)",
    """SELECT category, count(*) AS n FROM ca WHERE category IS NULL OR category NOT IN ('Git commands', 'Plan approvals', 'Code review/QA')
    GROUP BY 1""")

add("intent_classify", intent("lg_prompts"), """SELECT line, rule_key, rule_label, intent_key, intent_label, confidence, signals FROM ci""")
add("repeated_documents", REPEATED.replace("FROM lg_messages", "FROM lg_prompts"),
    "SELECT id, category, count, session_count, first_seen, last_seen FROM rg")
add("repeated_prompts", REPEATED, "SELECT * EXCLUDE (group_key) FROM rg ORDER BY count DESC, last_seen DESC NULLS LAST, sample LIMIT 10")
add("repeated_variants", REPEATED, """SELECT id, first(variant_sample ORDER BY file_path, line) AS sample, count(*) AS count,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ci JOIN (SELECT id, group_key FROM rg) USING (group_key)
    GROUP BY id, literal""")
add("repeated_projects", f"{REPEATED}, {ctx()}", """SELECT DISTINCT rg.id, coalesce(project, 'Unknown Project') AS project
    FROM ci JOIN rg USING (group_key) LEFT JOIN ctx ON ctx.file_path = ci.file_path AND ctx.session_id = ci.session_id""")
add("repeated_categories", REPEATED, "SELECT category, count(*) AS count FROM rg WHERE category IS NOT NULL GROUP BY 1")
add("intent_summary", INTENTS, f"SELECT intent_key, label, count, {share('ib')}, session_count, project_count, coalesce(examples, '') AS examples, first_seen, last_seen FROM ib")
add("intent_summary_visible", INTENTS + ", iv AS (SELECT * FROM ib WHERE label NOT IN ('Git commands', 'Plan approvals'))",
    f"SELECT intent_key, count, {share('iv')} FROM iv")
add("intent_totals", INTENTS, """SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS total_messages,
    CAST(coalesce(sum(count) FILTER (intent_key <> 'other'), 0) AS BIGINT) AS classified_messages,
    CAST(coalesce(sum(count) FILTER (intent_key = 'other'), 0) AS BIGINT) AS unclassified_messages FROM ib""")
add("intent_projects", INTENTS, """SELECT DISTINCT intent_key, coalesce(project, 'Unknown Project') AS project FROM ci
    LEFT JOIN ctx USING (file_path, session_id)""")
add("top_intents", INTENTS, "SELECT intent_key, count FROM ib ORDER BY count DESC, last_seen DESC NULLS LAST, label LIMIT 7")


def _rank(offset: int, order: str = "coalesce(timestamp, '') DESC, file_path, line, seq, session_id") -> str:
    return f"CAST({offset} + row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank"


_paged = "ORDER BY coalesce(timestamp, '') DESC, file_path, line, seq, session_id LIMIT {n} OFFSET {o}"
add("search_page", search_where("contains(literal, 'the')") + f""", pg AS (SELECT * FROM hits {_paged.format(n=20, o=5)}),
    pt AS (SELECT *, {jtrim('content')} AS tr FROM pg), ps AS (SELECT *, greatest(0, strpos(lower(tr), 'the') - 33) AS start FROM pt)""",
    f"SELECT {SEARCH_COLUMNS}, {SNIP}, {_rank(5)} FROM ps")
add("search_count", search_where("contains(literal, 'the')"), "SELECT count(*) AS total_matches FROM hits")
add("search_filters", search_where(f"""provider = 'codex' AND role = 'user' AND {SUB} AND project = 'proj-a' AND {ranged()}
      AND NOT coalesce(CASE WHEN cs THEN category END IN ('Git commands', 'Plan approvals'), false)""")
    + f""", pg AS (SELECT * FROM hits {_paged.format(n=50, o=0)}),
    ps AS (SELECT *, {jtrim('content')} AS tr, 0 AS start FROM pg)""", f"SELECT {SEARCH_COLUMNS}, {SNIP}, {_rank(0)} FROM ps")
for _name in ("search_page", "search_filters"):
    add(f"{_name}_index", SQL[_name][0], f"""SELECT * EXCLUDE (id)
        REPLACE (CASE WHEN turn_id IS NOT NULL THEN coalesce(model, 'unknown') END AS model) FROM ({SQL[_name][1]})""")
_unknown = "REPLACE (CASE WHEN turn_id IS NOT NULL THEN coalesce(model, 'unknown') END AS model)"
for _name in ("search_page", "search_filters"):
    add(f"{_name}_ranked", SQL[_name][0], f"SELECT * {_unknown} FROM ({SQL[_name][1]})")
add("browse_page_ranked", search_where("provider = 'codex'") + f""", pg AS (SELECT * FROM hits {_paged.format(n=500, o=200)}),
    ps AS (SELECT *, {jtrim('content')} AS tr, 0 AS start FROM pg)""", f"SELECT * {_unknown} FROM (SELECT {SEARCH_COLUMNS}, {SNIP}, {_rank(200)} FROM ps)")
add("search_model", search_where("contains(literal, 'an') AND coalesce(CASE WHEN turn_id IS NOT NULL THEN model END, 'unknown') = 'unknown'"),
    "SELECT file_path, session_id, line FROM hits")
add("message_index", search_where("true"), f"""SELECT concat_ws('#', file_path, provider, session_id, CAST(line AS VARCHAR),
    coalesce(turn_id, ''), coalesce(timestamp, ''), role, source_event, CAST(seq AS VARCHAR)) AS id, provider, provider_conversation_id,
    file_path, session_id, {day()} AS date_key, project, cwd, line, seq, turn_id,
    CASE WHEN turn_id IS NOT NULL THEN coalesce(model, 'unknown') END AS model, timestamp, role, source_event,
    CASE WHEN cs THEN category END AS category, CASE WHEN cs THEN intent_key END AS intent_key,
    CASE WHEN cs THEN intent_label END AS intent_label, literal AS normalized_content FROM hits""")
add("demo_search", ctx(), """SELECT m.file_path, m.session_id, line FROM lg_messages m LEFT JOIN ctx USING (file_path, session_id)
    WHERE role = 'user' AND contains(lower(content || ' ' || project), 'proj-a')""")

add("carry_forward", "x AS (SELECT 1)", f"""SELECT file_path, line, max(CASE WHEN {SUB} THEN line END) OVER
    (PARTITION BY file_path ORDER BY line, seq) AS last_prompt FROM lg_messages""")
add("prompt_ordinals", "x AS (SELECT 1)", f"""SELECT file_path, session_id, line, row_number() OVER
    (PARTITION BY file_path, session_id ORDER BY line, seq) AS prompt_no FROM lg_messages WHERE {SUB}""")
add("interaction_records", EVENTS, "SELECT file_path, session_id, line, seq, kind, prompt_line FROM ir")
add("interactions", EVENTS, """SELECT g.*, t.duration_ms, CAST(NULL AS DOUBLE) AS time_to_first_token_ms FROM (
    SELECT file_path, session_id, prompt_line AS line, any_value(turn_id) FILTER (kind = 'prompt') AS turn_id,
    any_value(timestamp) FILTER (kind = 'prompt') AS timestamp, any_value(content) FILTER (kind = 'prompt') AS prompt,
    count_if(kind = 'assistant') AS assistant_messages, count_if(kind = 'context') AS context_messages,
    count_if(kind = 'tool') AS tool_events, count_if(kind = 'tokens') AS token_events,
    last(content ORDER BY line, seq) FILTER (kind = 'assistant') AS last_response,
    last(total_tokens ORDER BY line, seq) FILTER (kind = 'tokens') AS total_tokens FROM ir GROUP BY 1, 2, 3) g
    LEFT JOIN lg_timings t ON t.file_path = g.file_path AND t.session_id = g.session_id AND t.turn_id = g.turn_id""")
add("hit_to_prompt", "x AS (SELECT 1)", f"""SELECT file_path, session_id, line, seq, role, source_event, coalesce(
    max(CASE WHEN {SUB} THEN line END) OVER (PARTITION BY file_path, session_id ORDER BY line, seq),
    min(CASE WHEN {SUB} THEN line END) OVER (PARTITION BY file_path, session_id)) AS prompt_line FROM lg_messages""")
_same = "x.file_path = p.file_path AND x.turn_id IS NOT DISTINCT FROM p.turn_id"
_reply = f"FROM lg_messages x WHERE {_same} AND x.line > p.line AND x.role NOT IN ('user', 'automation')"
add("turn_interactions", f"tp AS (SELECT * FROM lg_messages WHERE source_event = 'event_msg.user_message'), {intent('tp')}",
    f"""SELECT concat_ws('#', file_path, session_id, coalesce(turn_id, ''), CAST(line AS VARCHAR)) AS id, file_path, session_id, line,
    turn_id, timestamp, {jtrim('content')} AS user_message, coalesce(
      (SELECT last({jtrim('x.content')} ORDER BY x.line) {_reply} AND x.role = 'assistant'),
      (SELECT last({jtrim('x.content')} ORDER BY x.line) {_reply}),
      (SELECT first(last_agent_message ORDER BY session_id) FROM lg_timings x WHERE {_same}), '') AS assistant_message,
    coalesce((SELECT first(coalesce(model, 'unknown') ORDER BY x.line) FROM lg_turns x WHERE {_same}), 'unknown') AS model,
    (SELECT first(effort ORDER BY x.line) FROM lg_turns x WHERE {_same}) AS effort, intent_key, intent_label, category,
    (SELECT first(total_tokens ORDER BY x.line) FROM lg_usage x WHERE {_same}) AS total_tokens,
    (SELECT first(duration_ms ORDER BY session_id) FROM lg_timings x WHERE {_same}) AS duration_ms,
    CAST(NULL AS DOUBLE) AS time_to_first_token_ms,
    (SELECT count(*) FROM lg_tools x WHERE {_same}) AS tools,
    (SELECT count(*) {_reply} AND x.role IN ('developer', 'system')) AS context_messages FROM ci p""")

add("audit_responses", audit_parts(ranged()), """SELECT file_path, session_id, CAST(prompt_no AS BIGINT) AS prompt_no,
    min(line) FILTER (kind = 'prompt') AS line, count_if(kind = 'response') AS responses,
    min(timestamp) FILTER (kind = 'response') AS first_response, max(timestamp) FILTER (kind = 'response') AS last_response
    FROM ap GROUP BY 1, 2, 3""")
add("audit_sections", f"{audit_parts(ranged())}, {ctx()}", f"""SELECT substr(sha256(file_path || chr(10) || session_id), 1, 16) AS marker,
    file_path, session_id, any_value(project) AS project, any_value(cwd) AS cwd,
    {day('least(min(ap.timestamp), any_value(s_ts))')} AS date_label,
    any_value(coalesce(f.source_label, CASE f.provider WHEN 'codex' THEN 'Codex' WHEN 'claude' THEN 'Claude Code' ELSE 'Cursor' END)) AS provider_label,
    any_value(f.title) AS title, any_value(f.provider_conversation_id) AS provider_conversation_id,
    least(min(ap.timestamp), any_value(s_ts)) AS first_seen, greatest(max(ap.timestamp), any_value(s_ts)) AS last_seen,
    coalesce((SELECT string_agg(DISTINCT model, '|' ORDER BY model) FROM lg_turns t WHERE t.file_path = ap.file_path AND
      t.session_id = ap.session_id AND t.model <> '' AND t.turn_id IN (SELECT turn_id FROM ap a2 WHERE a2.file_path = ap.file_path
      AND a2.session_id = ap.session_id)), '') AS models,
    count_if(kind = 'prompt') AS prompts, count_if(kind = 'response') AS responses
    FROM ap JOIN lg_files f USING (file_path, session_id) JOIN ctx USING (file_path, session_id) GROUP BY file_path, session_id""")
add("audit_header", f"{audit_parts(ranged())}", """SELECT count(DISTINCT file_path || session_id) AS sessions,
    count_if(kind = 'prompt') AS user_messages, count_if(kind = 'response') AS responses,
    string_agg(DISTINCT CASE provider WHEN 'codex' THEN 'Codex' WHEN 'claude' THEN 'Claude Code' ELSE 'Cursor' END, ', '
      ORDER BY CASE provider WHEN 'codex' THEN 'Codex' WHEN 'claude' THEN 'Claude Code' ELSE 'Cursor' END) AS providers FROM ap""")
_quote = (f"CASE WHEN {jtrim('content')} = '' THEN '> [empty message]' ELSE array_to_string(list_transform("
          f"string_split(replace({jtrim('content')}, chr(13) || chr(10), chr(10)), chr(10)), "
          "lambda l: CASE WHEN l = '' THEN '>' ELSE '> ' || l END), chr(10)) END")
add("audit_blocks", f"""{audit_parts('true')}, ab AS (SELECT *, count_if(kind = 'response') OVER (PARTITION BY file_path, session_id, prompt_no) AS n,
      sum(CAST(kind = 'response' AS INT)) OVER (PARTITION BY file_path, session_id, prompt_no ORDER BY line, coalesce(timestamp, ''),
      source_event, seq) AS part FROM ap)""",
    f"""SELECT file_path, session_id, substr(sha256(file_path || chr(10) || session_id), 1, 16) AS marker, CAST(prompt_no AS BIGINT) AS prompt_no,
    CAST(part AS BIGINT) AS part_no, kind, CASE WHEN kind = 'prompt' THEN '### User Message ' || CAST(prompt_no AS BIGINT)
      WHEN n = 1 THEN '#### AI Response' ELSE '#### AI Response ' || CAST(part AS BIGINT) END || chr(10) || chr(10) ||
    CASE WHEN timestamp <> '' THEN 'Timestamp: ' || timestamp || chr(10) || chr(10) ELSE '' END || {_quote} || chr(10) ||
    CASE WHEN kind = 'prompt' AND n = 0 THEN chr(10) || '_No AI response was captured for this message in the parsed log._' || chr(10)
      ELSE '' END AS text FROM ab""")
_key = f"regexp_replace({jtrim('replace(content, chr(13) || chr(10), chr(10))')}, '[ \\t]+', ' ', 'g')"
add("audit_merge", f"""sp AS (SELECT *, CAST(regexp_extract(file_path, '([0-9]+)', 1) AS INT) % 4 AS n, {_key} AS qk FROM lg_messages
      SEMI JOIN lg_files USING (file_path, session_id) WHERE {SUB}),
    known AS (SELECT DISTINCT {_key} AS qk FROM lg_messages WHERE {SUB} AND CAST(regexp_extract(file_path, '([0-9]+)', 1) AS INT) % 4 = 2),
    all_sub AS (SELECT DISTINCT file_path, session_id, CAST(regexp_extract(file_path, '([0-9]+)', 1) AS INT) % 4 AS n FROM lg_messages WHERE {SUB}),
    sec AS (SELECT file_path, session_id, any_value(n) AS n, bool_and(qk IN (SELECT qk FROM known)) AS covered FROM sp GROUP BY 1, 2),
    st AS (SELECT count(*) AS generated_sections, count_if(n NOT IN (0, 1) AND NOT covered) AS appended_sections FROM sec)""",
    """SELECT appended_sections, generated_sections - appended_sections AS skipped_sections,
    (SELECT count(*) FROM all_sub WHERE n = 1) AS existing_sections, generated_sections FROM st""")
add("redact_text", f"rt AS (SELECT line, content, {redact('content')} AS r FROM lg_prompts)",
    "SELECT line, CAST(length(r) AS INT) AS n, md5(r) AS digest FROM rt WHERE r <> content")
add("sanitize_snippet", "x AS (SELECT 1)", f"""SELECT file_path, session_id, line,
    {flat(f"regexp_replace(content, {q('/Users/[^/' + WS[1:-1] + ']+/')}, '~/', 'g')")} AS text FROM lg_messages""")

add("eval_messages", eval_rows(), f"""SELECT eval_id, file_path, session_id, date_key, project, cwd, line, turn_id, timestamp, intent_key,
    intent_label, rule_key, confidence, signals, variant_sample AS snippet, reviewed, expected_key, is_correct, reviewed_at FROM er""")
add("eval_page", eval_rows(f"{ranged()} AND contains({norm('content')}, 'the')"), f"""SELECT eval_id, line, intent_key, expected_key,
    {_rank(0, "coalesce(timestamp, '') DESC, file_path, session_id, line, eval_id")} FROM er
    WHERE NOT is_correct ORDER BY coalesce(timestamp, '') DESC, file_path, session_id, line, eval_id LIMIT 7 OFFSET 2""")
add("eval_summary", f"{eval_rows()}, {EVAL_SUMMARY}", f"""SELECT key, {label('key')} AS label, total, reviewed, correct, incorrect, unreviewed,
    {ratio('correct', 'reviewed')} AS precision, {ratio('e_correct', 'e_reviewed')} AS recall FROM es""")
add("eval_report_categories", f"{eval_rows()}, {EVAL_SUMMARY.replace('FROM er GROUP BY 1', 'FROM er WHERE reviewed GROUP BY 1')}",
    f"""SELECT key, {label('key')} AS label, reviewed, correct, incorrect,
    {ratio('correct', 'reviewed')} AS precision, {ratio('e_correct', 'e_reviewed')} AS recall FROM es WHERE reviewed > 0""")
add("eval_totals", eval_rows(), f"""SELECT count(*) AS total_messages, count_if(reviewed) AS reviewed_messages, count_if(is_correct) AS correct_messages,
    count_if(NOT is_correct) AS incorrect_messages, {ratio('count_if(is_correct)', 'count_if(reviewed)')} AS reviewed_accuracy FROM er""")
add("eval_confusions", eval_rows(), f"""SELECT intent_key AS actual_key, any_value({label('intent_key')}) AS actual_label, expected_key,
    any_value({label('expected_key')}) AS expected_label, count(*) AS count FROM er WHERE NOT is_correct GROUP BY intent_key, expected_key""")
add("eval_report", eval_rows(ranged()), f"""SELECT (SELECT count(*) FROM rv) AS stored_reviews, count_if(reviewed) AS reviewed_in_scope,
    greatest(0, (SELECT count(*) FROM rv) - count_if(reviewed)) AS out_of_scope_or_missing, count(*) AS total_messages_in_scope,
    count_if(is_correct) AS correct, count_if(NOT is_correct) AS incorrect,
    {ratio('count_if(is_correct)', 'count_if(reviewed)')} AS reviewed_accuracy FROM er""")
add("fixture_draft", f"""{eval_rows()}, fd AS (SELECT *, row_number() OVER (PARTITION BY expected_key ORDER BY coalesce(timestamp, '') DESC,
      file_path, session_id, line, eval_id) AS n FROM er WHERE reviewed)""",
    f"""SELECT 'reviewed-' || expected_key || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id,
    'TODO: Replace with a sanitized synthetic prompt for ' || {label('expected_key')} || ' reviewed case ' || n || '.' AS message, expected_key,
    CASE WHEN NOT is_correct THEN intent_key END AS previous_key, 'Reviewed ' || CASE WHEN is_correct THEN 'correct' ELSE 'incorrect' END ||
    '. Current classifier: ' || {label('intent_key')} || ' via ' || rule_key || '. Replace this placeholder before committing.' AS notes,
    is_correct FROM fd""")
add("draft_totals", eval_rows(), """SELECT count(*) AS reviewed_messages, count_if(is_correct) AS correct_examples,
    count_if(NOT is_correct) AS incorrect_examples FROM er WHERE reviewed""")
add("review_upsert", REVIEWS, """SELECT eval_id, CASE WHEN substr(eval_id, 1, 1) < '8' THEN 'research' ELSE actual_key END AS actual_key, expected_key,
    substr(eval_id, 1, 1) < '8' AND expected_key = 'research' AS is_correct, CASE WHEN substr(eval_id, 1, 1) < '8' THEN 'changed' END AS note
    FROM rv WHERE substr(eval_id, 1, 1) <> 'f'""")
add("classifier_check", f"""{GOLD}, ge AS (SELECT expected_key AS key, count(*) AS expected, count_if(intent_key = expected_key) AS correct FROM gi GROUP BY 1),
    gp AS (SELECT intent_key AS key, count(*) AS predicted FROM gi GROUP BY 1),
    gc AS (SELECT coalesce(ge.key, gp.key) AS key, coalesce(expected, 0) AS expected, coalesce(predicted, 0) AS predicted,
      coalesce(correct, 0) AS correct FROM ge FULL JOIN gp ON ge.key = gp.key)""",
    f"SELECT key, {label('key')} AS label, expected, predicted, correct, {ratio('correct', 'predicted')} AS precision, {ratio('correct', 'expected')} AS recall FROM gc")
add("classifier_totals", GOLD, f"""SELECT count(*) AS total, count_if(intent_key = expected_key) AS correct,
    {ratio('count_if(intent_key = expected_key)', 'count(*)')} AS accuracy, CAST(0.5 AS DOUBLE) AS minimum_accuracy,
    count_if(intent_key = expected_key) = count(*) AS passed FROM gi""")
add("classifier_counts", GOLD, """SELECT 'rule' AS kind, rule_key AS name, CAST(NULL AS VARCHAR) AS other, count(*) AS count FROM gi GROUP BY 2
    UNION ALL SELECT 'confidence', confidence, NULL, count(*) FROM gi GROUP BY 2
    UNION ALL SELECT 'confusion', expected_key, intent_key, count(*) FROM gi WHERE intent_key <> expected_key GROUP BY 2, 3""")
add("classifier_changes", GOLD, """SELECT id, previous_key, intent_key AS actual_key, expected_key, CASE WHEN intent_key = expected_key
    THEN 'expected-change' ELSE 'unexpected-change' END AS status FROM gi WHERE previous_key IS NOT NULL AND previous_key <> intent_key""")
add("classifier_mismatches", GOLD, f"""SELECT id, expected_key, intent_key AS actual_key, rule_key, confidence, signals,
    CASE WHEN length({flat('message')}) > 120 THEN substr({flat('message')}, 1, 117) || '...' ELSE {flat('message')} END AS message
    FROM gi WHERE intent_key <> expected_key""")

add("secret_scan", secret_hits("doc_id"), "SELECT doc_id, rule, CAST(hits AS INT) AS hits FROM sh")
add("repository_scan", "x AS (SELECT 1)", " UNION ALL ".join(
    f"SELECT doc_id, {q(n)} AS rule, CAST(len(regexp_extract_all(text, {q(p)})) AS INT) AS hits FROM documents WHERE regexp_matches(text, {q(p)})"
    for n, p, _ in REPOSITORY_RULES))
add("secret_report", secret_hits("doc_id, source"),
    "SELECT source, rule, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS texts FROM sh GROUP BY 1, 2")
add("path_scan", """pp AS (SELECT url ||
    (['/a.PNG', '/dist/x.js', '/.env', '/k.pem', '/src/a.ts'])[page_id % 5 + 1] AS file_path FROM pages)""",
    " UNION ALL ".join(f"SELECT file_path, {q(n)} AS rule FROM pp WHERE regexp_matches(file_path, {q(('(?i)' if i else '') + p)})"
                       for n, p, i in PATH_RULES))
add("path_rewrite", "x AS (SELECT 1)", """SELECT CASE WHEN file_path IN (SELECT file_path FROM lg_files)
    THEN '/generated/' || regexp_extract(file_path, '([^/]*)$', 1) ELSE replace(file_path, '/home/dev', '/generated') END AS file_path,
    session_id, line, replace(cwd, '/home/dev', '/generated') AS cwd FROM lg_sessions""")

_clean = jtrim(r"regexp_replace(text, '\r\n', chr(10), 'g')")
add("normalize_codex_messages", "x AS (SELECT 1)", "WITH " + rollout(f"""tid AS turn_id, role,
    CASE role WHEN 'user' THEN 'event_msg.user_message' WHEN 'assistant' THEN 'event_msg.agent_message' ELSE 'response_item.message' END
    AS source_event, CASE role WHEN 'user' THEN {_clean} ELSE text END AS content, CASE WHEN role = 'assistant' THEN 'final' END AS phase""",
    "true", 3))
add("normalize_codex_tokens", "x AS (SELECT 1)", "WITH " + rollout("""tid AS turn_id, CAST(length(text) AS BIGINT) AS input_tokens,
    CAST(3 AS BIGINT) AS cached_input_tokens, CAST(0 AS BIGINT) AS cache_creation_input_tokens, CAST(3 AS BIGINT) AS cache_read_input_tokens,
    CAST(greatest(0, length(text) - 3) AS BIGINT) AS fresh_input_tokens, turn AS output_tokens, CAST(0 AS BIGINT) AS reasoning_output_tokens,
    CAST(length(text) + 3 + turn AS BIGINT) AS total_tokens""", "role = 'assistant'", 4))
add("normalize_codex_tools", "x AS (SELECT 1)", "WITH " + rollout(
    "tid AS turn_id, 'exec_command_end' AS event_type, turn AS exit_code, CAST(1.5 AS DOUBLE) AS duration_ms", "role = 'user'", 4))
add("normalize_codex_turns", "x AS (SELECT 1)", "WITH " + rollout(
    "tid AS turn_id, 'm' || (conv_id % 3) AS model, CASE WHEN sid LIKE 's%' THEN '/w/p' || (conv_id % 5) END AS cwd", "turn % 2 = 0", 2))
add("normalize_codex_unknown", "x AS (SELECT 1)", "WITH " + rollout(
    """'mystery' AS top_level_type, 'odd' AS payload_type,
    '{"timestamp":"2024-01-01T00:00:00Z","type":"mystery","payload":{"type":"odd","n":' || conv_id || '}}' AS raw""", "role = 'system'", 4))
add("normalize_codex_warnings", "x AS (SELECT 1)",
    "SELECT '/r/rollout-c' || conv_id || '.jsonl' AS file_path, turn * 5 + 2 AS line, 'malformed_json' AS code FROM conversations WHERE turn % 2 = 1")
add("normalize_codex_files", "x AS (SELECT 1)", """SELECT '/r/rollout-c' || conv_id || '.jsonl' AS file_path,
    last(session_id ORDER BY turn) AS session_id, max(turn) * 5 + 5 AS line_count FROM lg_conv GROUP BY conv_id""")
add("session_rows", "x AS (SELECT 1)", "WITH " + rollout("'/w/p' || (conv_id % 5) AS cwd", "turn = 0 OR (turn = 4 AND conv_id % 8 = 7)", 1))
add("task_timings", "x AS (SELECT 1)", """SELECT '/r/rollout-c' || conv_id || '.jsonl' AS file_path, first(session_id ORDER BY turn) AS session_id,
    't' || turn_no AS turn_id, CAST(last(turn * 10 ORDER BY turn) FILTER (role = 'assistant') AS DOUBLE) AS duration_ms
    FROM lg_conv GROUP BY conv_id, turn_no HAVING count_if(role = 'assistant') > 0""")
_cl = "cl AS (SELECT *, '/k/c' || conv_id || '.jsonl' AS file_path, turn + 1 AS line, CASE WHEN turn > 5 THEN 'Title ' || conv_id END AS title FROM lg_conv)"
add("normalize_claude", _cl, f"""SELECT file_path, 's' || conv_id AS session_id, line, 'u' || turn AS turn_id, role,
    'claude.' || role || '_message' AS source_event, {jtrim('text')} AS content, title FROM cl
    WHERE turn <> 5 AND ({jtrim('text')} <> '' OR role IN ('assistant', 'system'))""")
add("normalize_claude_sessions", _cl, """SELECT file_path, 's' || conv_id AS session_id, min(line) AS line,
    CASE WHEN bool_or(turn = 1) THEN '/w/lib' END AS cwd, CASE WHEN max(turn) >= 5 THEN 'Title ' || conv_id END AS title,
    's' || conv_id AS provider_conversation_id FROM cl GROUP BY conv_id, file_path""")
add("normalize_claude_tools", _cl, """SELECT file_path, 's' || conv_id AS session_id, line, 2 AS seq, 'tool_use' AS event_type, 'Read' AS name,
    'call' AS call_id, '{"n":' || turn || '}' AS content FROM cl WHERE turn <> 5""")
add("normalize_claude_tokens", _cl, """SELECT file_path, 's' || conv_id AS session_id, line, turn AS input_tokens, CAST(5 AS BIGINT) AS cached_input_tokens,
    CAST(2 AS BIGINT) AS cache_creation_input_tokens, CAST(3 AS BIGINT) AS cache_read_input_tokens, turn AS fresh_input_tokens,
    conv_id AS output_tokens, CAST(0 AS BIGINT) AS reasoning_output_tokens, turn + 5 + conv_id AS total_tokens FROM cl
    WHERE turn <> 5 AND role = 'assistant'""")
_kv = """kv AS (SELECT *, 'k' || conv_id AS sid, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS line,
    strftime(make_timestamp(1000000 * (1704067200 + 1000 - turn)), '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp FROM lg_conv WHERE turn <> 6)"""
add("normalize_cursor_kv", _kv, f"""SELECT sid AS session_id, line, 'b' || turn AS turn_id, timestamp, role,
    'cursor.' || role || '_message' AS source_event, {jtrim('text')} AS content FROM kv WHERE role IN ('user', 'assistant') AND {jtrim('text')} <> ''""")
add("normalize_cursor_kv_facts", _kv, """SELECT * FROM (SELECT sid AS session_id, line, CASE WHEN role = 'assistant' THEN turn + 4 END AS total_tokens,
    CASE WHEN turn = 1 THEN 'Run' END AS name, CASE WHEN turn = 1 THEN 'b1:tool:1' END AS call_id,
    CASE WHEN turn = 1 THEN 'out 1' END AS content FROM kv) WHERE total_tokens IS NOT NULL OR name IS NOT NULL""")
add("normalize_cursor_kv_warnings", "x AS (SELECT 1)", """SELECT conv_id * 100 + 7 AS line, 'malformed_cursor_record' AS code,
    'Could not parse Cursor bubble b6.' AS message FROM conversations WHERE turn = 6""")
add("normalize_markdown", "x AS (SELECT 1)", f"""SELECT '/m/c' || conv_id || '.md' AS file_path, 'c' || conv_id AS session_id,
    turn * 1000000 + 1 AS line, role, 'cursor.assistant_message' AS source_event, {_clean} AS content,
    CASE WHEN bool_or(role = 'system') OVER (PARTITION BY conv_id) THEN 'T' ELSE 'c' || conv_id || '.md' END AS title FROM lg_conv
    QUALIFY role = 'assistant' AND {_clean} <> ''""")

_k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
add("usage_struct", f"""us AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS i, CASE WHEN {_k} % 2 = 0 THEN {_k} END AS c,
    CASE WHEN {_k} % 3 = 0 THEN {_k} ELSE 0 END AS cr, CASE WHEN {_k} % 7 = 0 THEN 999 END AS t FROM events)""",
    """SELECT event_id, i AS input_tokens, coalesce(c, cr) AS cached_input_tokens, cr AS cache_creation_input_tokens,
    coalesce(c, 0) AS cache_read_input_tokens, CASE WHEN c IS NULL THEN i ELSE greatest(0, i - c) END AS fresh_input_tokens,
    CAST(0 AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS reasoning_output_tokens, CAST(coalesce(t, i + cr + coalesce(c, 0)) AS BIGINT) AS total_tokens FROM us""")
add("usage_struct_cursor", f"""us AS (SELECT event_id, CASE WHEN {_k} % 2 = 0 THEN {_k} ELSE 0 END AS input_tokens,
    CASE WHEN {_k} % 3 = 0 THEN {_k} ELSE 0 END AS output_tokens FROM events)""",
    "SELECT event_id, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens FROM us WHERE input_tokens + output_tokens <> 0")
add("prompt_text", f"""{DOCS}, pt AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN
    CASE WHEN {jtrim('text')} = '' THEN 'second' ELSE {jtrim('text')} || chr(10) || chr(10) || 'second' END ELSE {_clean} END AS t FROM d)""",
    "SELECT doc_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM pt")
add("content_to_text", "x AS (SELECT 1)", """SELECT conv_id, turn, CASE WHEN text <> '' THEN text || chr(10) ELSE '' END || role || chr(10) || 'nested' ||
    chr(10) || 'nested' AS text FROM conversations""")
_list = ",".join(str(i) for i in range(1, 21))
add("bounded_raw", DOCS, f"""SELECT doc_id, '{{"text":' || CASE WHEN length(text) > 4096 THEN
      '{{"truncated":true,"type":"string","length":' || length(text) || '}}' ELSE CAST(to_json(text) AS VARCHAR) END || ',"x":{{"n":' || doc_id ||
    ',"list":[{_list},{{"truncated":true,"type":"array","remainingItems":2}}]}}}}' AS raw, true AS raw_truncated FROM d""")

_old = "o AS (SELECT '/in/' || source || '/' || doc_id AS file_path, n_chars AS size FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 17 <> 0)"
_new = "n AS (SELECT '/in/' || source || '/' || doc_id AS file_path, n_chars + CAST(doc_id % 7 = 0 AS INT) AS size FROM documents WHERE doc_id % 10 <> 1)"
add("manifest_diff", f"{_old}, {_new}", """SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN n.file_path IS NOT NULL AND n.size = o.size THEN 'reuse'
    WHEN n.file_path IS NOT NULL THEN 'parse' WHEN split_part(o.file_path, '/', 3) IN ('src1', 'src2', 'src11') THEN 'remove' ELSE 'keep' END AS action
    FROM o FULL JOIN n ON o.file_path = n.file_path""")
add("refresh_counts", f"{_old}, {_new}, j AS (SELECT o.size AS a, n.size AS b FROM o FULL JOIN n ON o.file_path = n.file_path)",
    """SELECT count_if(a = b) AS reused_files, count_if(b IS NOT NULL AND a IS DISTINCT FROM b) AS parsed_files, count_if(b IS NULL) AS removed_files,
    count_if(b IS NOT NULL) AS total_files, 'updated' AS status FROM j""")


def oracle() -> dict[str, str]:
    """Complete statements: the views, the query's own expressions, the result."""
    views = duckdb_views()
    return {name: f"{views},\n{ctes}\n{select}" if not select.startswith("WITH ") else f"{views},\n{select[5:]}"
            for name, (ctes, select) in SQL.items()}
