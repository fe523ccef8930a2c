"""Rule-based prompt intents as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import compact, java_regex, normalize_text

# Category keys and labels.
CATEGORIES = {
    "feature-design": "Feature design",
    "implementation": "Implementation",
    "bug-fixes": "Bug fixes",
    "git-commands": "Git commands",
    "deploy-release-run-build": "Deploy/release/run/build",
    "code-review-qa": "Code review/QA",
    "planning-strategy": "Planning/strategy",
    "research": "Research",
    "documentation": "Documentation",
    "testing-verification": "Testing/verification",
    "refactor-cleanup": "Refactor/cleanup",
    "content-creation": "Content creation",
    "data-analysis": "Data/metrics",
    "feedback-context": "Context/observation",
    "plan-approvals": "Plan approvals",
    "other": "Other",
}

# Categories whose prompts count as one message per category.
OPERATIONAL = ["code-review-qa", "deploy-release-run-build", "git-commands", "plan-approvals", "testing-verification"]

# Rules in order - rule key, category key, rule label, confidence, signals.
RULES = [
    ("plan-approval", "plan-approvals", "Short approval", "high", ["approval"]),
    ("deploy-release", "deploy-release-run-build", "Deploy/release wording", "high", ["deploy-release"]),
    ("git-command", "git-commands", "Git command wording", "high", ["git-command"]),
    ("run-build-app", "deploy-release-run-build", "Run/build app wording", "high", ["run-build-app"]),
    ("code-review-qa", "code-review-qa", "Review/QA wording", "high", ["code-review-qa"]),
    ("testing-verification", "testing-verification", "Testing/verification wording", "high", ["testing-verification"]),
    ("documentation", "documentation", "Documentation wording", "high", ["documentation"]),
    ("direct-bug-fix", "bug-fixes", "Direct bug-fix request", "high", ["direct-fix", "bug-signal"]),
    ("feature-design-mixed-bug-rationale", "feature-design", "Feature work with incidental bug rationale", "medium",
     ["strong-feature-signal", "bug-rationale"]),
    ("bug-fix", "bug-fixes", "Bug/problem wording", "medium", ["bug-signal"]),
    ("planning-strategy", "planning-strategy", "Planning/strategy wording", "high", ["planning-strategy"]),
    ("data-analysis", "data-analysis", "Data/metrics wording", "high", ["data-analysis"]),
    ("content-creation", "content-creation", "Content creation wording", "high", ["content-creation"]),
    ("strong-feature-design", "feature-design", "Explicit feature/capability wording", "high",
     ["strong-feature-signal"]),
    ("refactor-cleanup", "refactor-cleanup", "Refactor/cleanup wording", "high", ["refactor-cleanup"]),
    ("feature-design", "feature-design", "Feature/design wording", "medium", ["feature-design"]),
    ("implementation", "implementation", "Implementation wording", "medium", ["implementation"]),
    ("research", "research", "Research/investigation wording", "medium", ["research"]),
    ("context-observation", "feedback-context", "Context/observation wording", "medium", ["context-observation"]),
    ("broad-action-request", "implementation", "Broad action request", "low", ["broad-action"]),
    ("fallback-context", "feedback-context", "Fallback non-empty prompt", "low", ["non-empty"]),
    ("empty-prompt", "other", "Empty prompt", "low", ["empty"]),
]

# Leading and trailing courtesy that a command drops.
COURTESY = (r"^(?:(?:ok|okay)[, ]+|(?:please|pls)[, ]+|(?:can|could|would) you\s+|i would like (?:you )?to\s+"
            r"|i want (?:you )?to\s+|let'?s\s+)+")
TRAILING_COURTESY = r"\s+(please|for me)$"

# The names an application is asked for by; a product's own name can be added per call.
APP_NAMES = ["it", "the app", "the application", "codex"]

# Word patterns of the rules.
APPROVAL_LIMIT = 80
APPROVAL = [
    r"^(yes|yeah|yep|yup|sure|ok|okay|approved|confirmed|execute)$",
    r"^(yes|yeah|yep|yup|sure|ok|okay),? (please|go ahead|proceed|do it|do that|sounds good|let's do it|lets do it)$",
    r"^(sounds good|looks good|that works|works for me|go ahead|please do|yes please do|do it|do that|proceed|approved|confirmed|ship it|let's do it|lets do it|let's do that|lets do that|execute it|execute that|execute this|execute the plan|execute the changes)( please)?$",
]
RELEASE_NOTES = r"\brelease notes?\b"
DEPLOY = [
    r"^(publish|deploy|release|ship)( (it|this|the app|the build|the release|the site|the website|to (main|origin|github|production|prod|release)|production|prod))?$",
    r"\b(deploy|deployment|release|production|prod|notariz(?:e|ation)|distribution|ship(?:ped|ping)?)\b",
]
GIT = [
    r"^(git )?(commit|comet|push|merge|rebase|branch|checkout|switch|pull|fetch|stash|tag|open pr|create pr|close pr|merge pr)\b",
    r"^git (status|diff|log)\b",
    r"^(create|make|open|merge|close|delete|remove|clean|switch|checkout) ((a|the|current|new|this) )*(branch|commit|pull request|pr|worktree|work tree)\b",
    r"^(close|delete|remove|clean) ((the|current|this) )*(worktree|work tree)\b",
    r"^are all files\b",
    r"^(are|is|did|do|does|have|has)\b.*\b(all|everything|files?|changes?|work|worktree|work tree|repo|repository|anything|we)\b.*\b(committed|commited|commit|pushed|push|staged|unstaged|uncommitted|dirty|clean|checked in)\b\??$",
    r"^(all|everything|files?|changes?|anything|repo|repository|worktree|work tree)\b.*\b(committed|commited|pushed|staged|unstaged|uncommitted|dirty|clean)\b\??$",
]
RUN_BUILD = [
    r"^(run|start|restart|launch|open|relaunch|rerun) (the )?(app|application|desktop app|mac app|macos app|native app|packaged app|server|local server|dev server|development server)\b",
    r"^(run|start|restart) (npm run dev|dev|desktop|local app)\b",
    r"\b(rebuild|build|package|packaged|relaunch|restart|run|start)\b.*\b(app|application|server|local|mac app|macos app|native app)\b",
]
REVIEW = [
    r"^(code review|do a code review|run a code review|review code|review the code|review this code|review the diff|review the changes)\b",
    r"^(review|inspect|audit) (the )?(code|diff|changes|change set|pull request|pr|implementation)\b",
    r"\b(p0|p1|p2|p3|regression risk|code review|review finding|finding)\b",
]
TESTING = [
    r"^(run|rerun|execute|fix|update)? ?(the )?(tests?|test suite|lint|smoke test|accessibility check|typecheck|verification)\b",
    r"\b(test|tests|tested|testing|lint|typecheck|smoke|qa|verify|verification|accessibility|playwright|screenshot check)\b",
]
DOCUMENTATION = [
    r"\b(docs?|documentation|readme|usage guide|help|worklog|ai worklog|changelog|release notes?|write-up|guide)\b",
]
DIRECT_FIX = [
    r"^(fix|repair|resolve|debug|address|correct)\b",
    r"^(can|could|would) (you|we) (please )?(fix|repair|resolve|debug|address|correct)\b",
    r"\bbug fixes?\b",
    r"\b(fix|repair|resolve|debug|address|correct)\b.{0,80}\b(bug|broken|wrong|not working|doesn'?t work|isn'?t working|fails?|failing|failure|error|crash|regression|issues?|problem|p0|p1|p2|p3)\b",
    r"\b(bug|broken|wrong|not working|doesn'?t work|isn'?t working|fails?|failing|failure|error|crash|regression|issues?|problem|p0|p1|p2|p3)\b.{0,80}\b(fix|repair|resolve|debug|address|correct)\b",
]
STRONG_FEATURE = [
    r"\b(features? (we )?(need|want|should|have) to (add|build|create|support|include)|add(?:ing)? (a |an |the |new )?features?|new features?|feature work)\b",
    r"\b(add|build|create|show|display|put|include|support|enable|wire|hook up)\b.{0,120}\b(dialog|loading|notice|indicator|spinner|feedback|sync|synchroni[sz]e|background|refresh|filter|setting|option|button|view|chart|summary|panel|window|sidebar|column|label|badge|workflow)\b",
    r"\bi want ({app_names}) to\b",
    r"\b(ability to|option for|new capability|periodically synchroni[sz]e|background sync)\b",
]
BUG = [
    r"^(fix|repair|resolve|debug|address|correct)\b",
    r"\b(bug|broken|wrong|not working|doesn'?t work|isn'?t working|fix(?:ed|ing)?|fails?|failing|failure|error|crash|regression|issues?|problem|p0|p1|p2|p3)\b",
    r"\b(still seeing|why do we have|why is|what happened|this is wrong|this looks wrong|it is not|this is not|when i click)\b",
]
CLEANUP = [
    r"\b(declutter|clean ?up|cleanup|simplify|reorganize|remove|hide|go away|reclaim|less clutter|we don'?t need|you don'?t need|i don'?t want|move .* menu|move .* bottom|rename|refactor|dedupe|consolidate)\b",
]
PLANNING = [
    r"^(\/plan|create a plan|make a plan|plan this|plan it|create an implementation plan)\b",
    r"\b(strategy|roadmap|approach|proposal|prioriti[sz]e|trade-?offs?|recommendation|recommend|honest opinion|do we need|we need to|i think we|i don'?t think|i am not sure|i'?m not sure|are we ready|are we all|are you sure|save this plan|should we|should i|what should|what can we|what are the key|best way|figure out the best|take a step back)\b",
]
DATA = [
    r"\b(data|dataset|spreadsheet|csv|table|chart|graph|metrics?|analytics?|report|dashboard|scorecard|calculate|count|breakdown|visuali[sz]e|pie chart|bar chart)\b",
]
CONTENT = [
    r"\b(generate|draft|compose|rewrite|copy|headline|tagline|article|blog post|post|email|letter|logo|image|illustration|poster|deck|slides?|presentation|caption|bio|announcement)\b",
]
DESIGN = [
    r"\b(design|ux|ui|usability|visibility|layout|interaction|experience|principal designer|senior designer|feature|ability to|option for|i want to|i want the|i also want|now i want|i would like|can we|can you also|can you make|should we|what can we|improve|make .* better|this needs to|this should be|center the|slow down|filter(?:ing)?|settings?)\b",
]
IMPLEMENTATION = [
    r"^(\/goal|implement|execute|build|add|create|make|change|update|show|enable|disable|support|wire|hook up|connect|integrate|replace|do all of|give me|notice that|also notice that|you are worker)\b",
    r"\b(implement|implementation|execute this|build this|add this|make this|change this|update this|hook this up|wire this up|integrate this|support this)\b",
]
RESEARCH = [
    r"\b(research|investigate|look into|take a look|look at|understand|analy[sz]e|compare|find out|figure out|why|what is|what does|what are these|how can|how do i|where do i|can you tell|can you estimate|get a sense|explore|inspect logs?|explain)\b",
]
CONTEXT = [
    r"\b(i have updated|i updated|for context|context:|this is what|here is|here are|a lot of|note that|also notice|notice that|i'?m seeing|i am seeing|i see|i noticed|it looks like|it seems|there is|there are|the screenshot|screenshot)\b",
]
BROAD_ACTION = [
    r"^(can you|could you|please|let'?s|all right do|alright do|okay can you|can you do|do all of|make sure|ensure)\b",
]

# For every way in which a pattern that may match anywhere can match, its longest whole word other than `this`; without any of them it cannot match.
KEY_WORDS = {
    "DEPLOY": "deploy deployment distribution notarization notarize prod production release ship shipped shipping",
    "RUN_BUILD": "build package packaged rebuild relaunch restart run start",
    "REVIEW": "finding p0 p1 p2 p3 regression review",
    "TESTING": "accessibility lint playwright qa screenshot smoke test tested testing tests typecheck verification verify",
    "DOCUMENTATION": "changelog doc docs documentation guide help readme release usage worklog write",
    "DIRECT_FIX": ("address broken bug correct crash debug doesn doesnt error fail failing fails failure fix fixe fixes issue "
                   "issues p0 p1 p2 p3 problem regression repair resolve working wrong"),
    "STRONG_FEATURE": ("ability add background build capability create display enable feature features hook include option "
                       "periodically put show support want wire"),
    "BUG": ("broken bug click crash doesn doesnt error fail failing fails failure fix fixed fixing happened have issue "
            "issues looks not p0 p1 p2 p3 problem regression seeing why working wrong"),
    "CLEANUP": ("away clean cleanup clutter consolidate declutter dedupe dont hide move need reclaim refactor remove "
                "rename reorganize simplify want"),
    "PLANNING": ("approach are best figure need opinion prioritise prioritize proposal ready recommend recommendation "
                 "roadmap save should strategy sure take think trade tradeoff tradeoffs what"),
    "DATA": ("analytic analytics breakdown calculate chart count csv dashboard data dataset graph metric metrics report "
             "scorecard spreadsheet table visualise visualize"),
    "CONTENT": ("announcement article bio blog caption compose copy deck draft email generate headline illustration image "
                "letter logo post poster presentation rewrite slide slides tagline"),
    "DESIGN": ("ability also can center design designer experience feature filter filtering improve interaction layout "
               "make needs option principal setting settings should slow ui usability ux visibility want what would"),
    "IMPLEMENTATION": "add build change execute hook implement implementation integrate make support update wire",
    "RESEARCH": ("analyse analyze compare estimate explain explore figure find how inspect investigate look research sense "
                 "take tell these understand what where why"),
    "CONTEXT": "context here looks lot note notice noticed screenshot see seeing seems there updated what",
}


def command_text(literal: Column) -> Column:
    """A normalized prompt without leading and trailing courtesy."""
    def ended(text: Column) -> Column:
        polite = text.endswith("please") | text.endswith("for me")  # spares the scan of any other text
        return F.when(polite, F.regexp_replace(text, java_regex(TRAILING_COURTESY), "")).otherwise(text)

    return F.trim(_bind(F.regexp_replace(literal, java_regex(COURTESY), ""), ended))


def _any(c: Column, patterns: list[str], possible: Column | None = None) -> Column:
    """True when one of the patterns matches.

    Those bound to the start are tried there, one by one.  One regex scans the whole text for all others, only where ``possible``.
    """
    bound = [p for p in patterns if p.startswith("^")]
    anywhere = "|".join(f"(?:{java_regex(p)})" for p in patterns if p not in bound)
    hit = None
    for pattern in bound:
        test = c.rlike(java_regex(pattern))
        if pattern.count(".*") > 1:
            # The start and the tail, required at the very end, are tested first: that spares the nested scans of long texts.
            start, tail = pattern.split(".*", 1)[0], pattern.rsplit(".*", 1)[1]
            test = c.rlike(java_regex(start)) & c.rlike(java_regex(tail)) & test
        hit = test if hit is None else hit | test
    if anywhere:
        found = c.rlike(anywhere) if possible is None else possible & c.rlike(anywhere)
        hit = found if hit is None else hit | found
    return hit


def _key_words(literal: Column) -> Column:
    """The key words that a normalized prompt holds."""
    known = F.array(*[F.lit(w) for w in sorted({w for words in KEY_WORDS.values() for w in words.split()})])
    return F.array_intersect(F.split(literal, r"\W+"), known)


def _is_approval(literal: Column) -> Column:
    bare = F.regexp_replace(literal, java_regex(r"[.!]+$"), "")
    bare = F.trim(F.regexp_replace(bare, java_regex(r"\s*,\s*"), ", "))
    return (F.length(literal) <= APPROVAL_LIMIT) & _any(bare, APPROVAL)


def rule_number(literal: Column, command: Column, match: Column, app_names: list[str] = APP_NAMES) -> Column:
    """1-based number of the first rule that applies.

    ``command`` and ``match`` hold no words but those of ``literal``, which is split into its key words once; a rule none of whose words is
    there scans no text.
    """
    return _bind(_key_words(literal), lambda words: _rule_number(literal, command, match, words, app_names))


def _rule_number(literal: Column, command: Column, match: Column, words: Column, app_names: list[str]) -> Column:
    def any_of(text: Column, name: str, patterns: list[str] | None = None) -> Column:
        keys = KEY_WORDS.get(name)
        possible = F.arrays_overlap(words, F.array(*[F.lit(w) for w in keys.split()])) if keys else None
        return _any(text, patterns or globals()[name], possible)

    strong = [p.replace("{app_names}", "|".join(app_names)) for p in STRONG_FEATURE]
    bug, feature = any_of(match, "BUG"), any_of(match, "STRONG_FEATURE", strong)
    tests = [
        _is_approval(literal),
        any_of(command, "DEPLOY") & ~command.rlike(java_regex(RELEASE_NOTES)),
        any_of(command, "GIT"),
        any_of(command, "RUN_BUILD"),
        any_of(command, "REVIEW"),
        any_of(match, "TESTING"),
        any_of(match, "DOCUMENTATION"),
        any_of(literal, "DIRECT_FIX") | ((command != literal) & any_of(command, "DIRECT_FIX")),
        bug & feature,
        bug,
        any_of(match, "PLANNING"),
        any_of(match, "DATA"),
        any_of(match, "CONTENT"),
        feature,
        any_of(match, "CLEANUP"),
        any_of(match, "DESIGN"),
        any_of(match, "IMPLEMENTATION"),
        any_of(match, "RESEARCH"),
        any_of(match, "CONTEXT"),
        any_of(match, "BROAD_ACTION"),
        literal != "",
    ]
    number = F.when(tests[0], 1)
    for i, test in enumerate(tests[1:], start=2):
        number = number.when(test, i)
    return number.otherwise(len(RULES))


def _lookup(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the optimizer copies the expression into a filter."""
    return F.transform(F.array(value), body)[0]


def intent_struct(content: Column, app_names: list[str] = APP_NAMES) -> Column:
    """Struct (literal, rule_no, polite): normalized prompt, first rule that applies, courtesy dropped."""
    def classified(literal: Column, command: Column) -> Column:
        match = F.when(command == literal, literal).otherwise(F.concat_ws(" ", literal, command))
        number = _bind(match, lambda m: rule_number(literal, command, m, app_names))
        return F.struct(literal.alias("literal"), number.alias("rule_no"), (command != literal).alias("polite"))

    return _bind(normalize_text(content), lambda lit: _bind(command_text(lit), lambda cmd: classified(lit, cmd)))


def with_intent(df: DataFrame, content: str = "content", app_names: list[str] = APP_NAMES) -> DataFrame:
    """Add literal, rule_no, rule_key, rule_label, confidence, signals, intent_key and intent_label."""
    step = df.withColumn("_intent", intent_struct(F.col(content), app_names))
    number = F.col("_intent.rule_no")
    signals = F.element_at(F.array(*[F.array(*[F.lit(s) for s in r[4]]) for r in RULES]), number)
    extra = F.when(F.col("_intent.polite") & (number <= len(RULES) - 2),
                   F.array(F.lit("normalized-command"))).otherwise(F.array().cast("array<string>"))
    return step.select(
        *df.columns, F.col("_intent.literal").alias("literal"), number.alias("rule_no"),
        _lookup([r[0] for r in RULES], number).alias("rule_key"),
        _lookup([r[2] for r in RULES], number).alias("rule_label"),
        _lookup([r[3] for r in RULES], number).alias("confidence"),
        F.concat(signals, extra).alias("signals"),
        _lookup([r[1] for r in RULES], number).alias("intent_key"),
        _lookup([CATEGORIES[r[1]] for r in RULES], number).alias("intent_label"),
    )


def category_label(key: Column) -> Column:
    """Display label of a category key; unknown keys are their own label."""
    out = F.when(key == "feature-design", CATEGORIES["feature-design"])
    for name, label in list(CATEGORIES.items())[1:]:
        out = out.when(key == name, label)
    return out.otherwise(key)


def group_key() -> Column:
    """What prompts are grouped by, from their category, intent and normalized text."""
    return F.when(F.col("category").isNotNull(), F.concat(F.lit("category:"), F.col("intent_key"))).otherwise(F.col("literal"))


def with_group_key(df: DataFrame, content: str = "content", app_names: list[str] = APP_NAMES) -> DataFrame:
    """Intent columns plus category (operational prompts only), group_key, variant_sample and group_sample."""
    step = with_intent(df, content, app_names)
    step = step.withColumn("category", F.when(F.col("intent_key").isin(*OPERATIONAL), F.col("intent_label")))
    step = step.withColumn("variant_sample", compact(F.col(content), 240))
    return step.withColumn("group_key", group_key()).withColumn("group_sample", F.coalesce("category", "variant_sample"))
