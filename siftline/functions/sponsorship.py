"""Whether a posting sponsors work visas: every statement about it, what each one says in its clause, and one decision.

A span is an offer, a denial, or a bare mention of sponsorship. Its clause then settles it: an offer under a negation denies; a
negation of a negation says nothing; a denial of "every" case limits the scope, one of "all" may mean either; a hedge or a
condition makes an offer a maybe; sponsorship of export licences or of street fairs is none. Conflicts go to review; a settled
denial outranks what is unsettled, an offer outranks a hedged one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import evidence as E
from siftline.functions.evidence import Rule

# ---- fixed values: phrases and words that decide, in normalised spelling ("us" for U.S., "h1b", "can not", "not" for n't)

STATUS = r"(?:gc|green card|(?:us )?citizens?(?:hip)?|permanent residents?)"
US_PERSON = r"(?:(?:us|american|united states) citizens?(?:hip)?|citizens? of the united states|(?:lawful )?permanent residents?|green card holders?)"
NOW = r"(?:currently |presently |now |at this time )?"
RULES = (
    Rule("us_person_required", "person", rf"(?:candidates?|applicants?|employees?|engineers?|hires?|you)\b[^.;:!?]{{0,40}}? must (?:also |already )?(?:be|have|hold|possess|maintain|establish|show|document|provide proof of|be able to establish) (?:an? |the )?[^.;:!?]{{0,20}}?{US_PERSON}"),
    Rule("citizens_only", "denial", r"us citizens only|must be an? us citizen"),
    Rule("citizenship_required", "field", r"(?:us )?citizen(?:ship)?[ :?-]*(?:is |are )?required"),
    Rule("green_card_only", "denial", r"green card (?:holders only|required)|gc only|permanent resident only"),
    Rule("visa_field", "list", rf"visa ?: ?{STATUS}(?: ?[/,&] ?{STATUS})*(?: only)?"),
    Rule("not_required", "denial", r"(?:does|do|must) not require sponsorship|not require sponsorship now or in the future"),
    Rule("without", "denial", r"without (?:(?:the )?need for (?:(?:any )?(?:current|future|ongoing)(?: or (?:current|future|ongoing))? )?)?(?:visa |employer |employment |immigration |work )?sponsorship"),
    Rule("none", "denial", r"no (?:visa )?sponsorship"),
    Rule("not_offered", "denial", r"not (?:offer|provide) sponsorship|not offering visa sponsorship|unable to provide (?:visa )?sponsorship|not able to provide visa sponsorship"),
    Rule("not_available", "denial", r"(?:visa )?sponsorship (?:support )?(?:will not be|is not|not) available"),
    Rule("not_eligible", "denial", r"not eligible for (?:visa )?sponsorship"),
    Rule("verb_pair", "verb", rf"(?:can not|could not|unable to|not able to|do not|does not|did not|will not|are not|is not) {NOW}sponsor (?:or|nor|and) (?:support|provide|facilitate|assist with)"),
    Rule("verb", "verb", r"(?:unable to|not able to|can not|will not|does not|do not) sponsor"),
    Rule("not_sponsoring", "denial", rf"not {NOW}(?:or in the foreseeable future )?sponsoring (?:new |any |additional |further )?(?:employment[- ]based |employment |work |h1b )?visas?"),
    Rule("visa_offer", "strong", r"(?:(?:we|will|to) )?sponsor (?:h1b|(?:work )?visas)|(?:h1b|immigration|green card) sponsorship(?: available)?|visa sponsorship (?:is )?available|(?:offer|provide) visa sponsorship|green card process|perm process|cap[- ]exempt"),
    Rule("offer", "weak", r"sponsorship (?:is )?(?:available|offered)|(?:we|will) sponsor|happy to sponsor|open to sponsoring|able to sponsor|immigration (?:support|assistance)|visa support|relocation and immigration|h1b transfers?"),
    Rule("mention", "head", r"(?:(?:visa|immigration|employment|employer|h1b|green card) )?sponsorship"),
)
CUE = r"\b(?:not|no|never|none|unable|unavailable|unavailability|ineligible|without|nor|neither|lacks?|lacking)\b"
SENTENCE = r"[.;:!?•|]"
HARD = r"[.;:!?•|]|--|—|–|\b(?:but|however|although|though|yet|whereas|while|nevertheless|nonetheless|unless|otherwise|instead)\b"
SUBJECT = r"(?:we|they|it|you|he|she|i|this|these|those|that|our|your|their|the|a|an|candidates?|applicants?|employees?|employers?|positions?|roles?|is|are|was|were|will|can|may|might|would|should|must|do|does|did|has|have|had)\b"
TOPIC_VERB = r"(?:visas?|sponsorship|immigration|h1b|green card|perm)\b[^.;:!?]{0,40}?\b(?:is|are|will|can|may|would)\b"
JOIN = r"(?:,(?: and| or| plus)?|\band\b|\bor\b|\bplus\b) "
BREAK = rf"{HARD}|{JOIN}{SUBJECT}|{JOIN}{TOPIC_VERB}"
AHEAD = rf"{BREAK}|\b(?:who|whom|whose|which|because|since|so that|in order|as long as|provided that|assuming)\b|{JOIN}there\b"
TOPIC = r"\b(?:sponsor(?:s|ed|ing|ship)?|visas?|immigration|h1b|green card|perm|work authorization|citizens?(?:hip)?|relocation)\b"
VERB = r"\b(?:offer(?:s|ed|ing)?|provid(?:e|es|ed|ing)|extend(?:s|ed|ing)?|grant(?:s|ed|ing)?|support(?:s|ed|ing)?|arrang(?:e|es|ed|ing)|fund(?:s|ed|ing)?|coordinat(?:e|es|ed|ing)|furnish(?:es|ed|ing)?|facilitat(?:e|es|ed|ing)|sponsor(?:s|ed|ing)?|programs?|policies|policy|provisions?|budgets?|pathways?|mechanisms?)\b"
EACH = r"\b(?:every(?:one|body)?|each|guarantee(?:s|d|ing)?)\b"
ALL = r"\ball\b"
HEDGE = r"\b(?:may|might|could|possibl[ey]|potentially|limited|discretion(?:ary)?|consider(?:s|ed|ation)?|sometimes|occasionally|selectively|case[- ]by[- ]case|in some cases|from time to time)\b"
CONDITION = r"\b(?:if|once|when|after|unless|upon|pending|assuming|provided|subject to|contingent (?:up)?on)\b[^.;:!?]{0,40}?\b(?:approv\w+|sign(?:s|ed)? off|legal|counsel|attorney|immigration team|budget|headcount|business need|case[- ]by[- ]case|discretion(?:ary)?)\b"
EXPORT = r"\b(?:export (?:licen[cs]e[sd]?|control(?:led|s)?|administration regulations|compliance|classification|authoriz\w+|restrictions?)|export-controlled|itar|ear99|deemed export|licen[cs]e exception|international traffic in arms)\b"
CONTEXT = r"\b(?:visas?|h1bs?|immigration|work authoriz\w+|green cards?|permanent residency|perm process|employment sponsorship)\b"
IMMIGRATION = r"\b(?:visas?|h1bs?|immigration|work authoriz\w+|authoriz\w+ to work|green cards?|permanent residen(?:t|ts|cy)|perm process|employment sponsorship|citizens?(?:hip)?|sponsorship transfers?)\b"
NEW_PETITION = r"\b(?:new|initial|first[- ]time|cap[- ]subject)\b[^.;:!?]{0,24}?\b(?:petitions?|filings?|cases?)\b"
TRANSFER = r"\b(?:h1bs? transfers?|transfer(?:s|red|ring)? (?:your|their|an existing|a current|the existing) (?:h1b|visa)|cap[- ]exempt)\b"
SIGNAL = r"\b(?:sponsor(?:ship|ing)?|visa|immigration|work authorization|h1b|green card|perm)\b"
ESCAPE = r"^[^.;:!?]{0,60}?\b(?:h1bs?|ead|opt|cpt|tn visas?|visa holders?|work visas?|sponsorship|authoriz\w+ to work)\b"
DENIED_FIELD = r"^ ?[:?]? ?(?:no|not|false|n/a)\b"
MORE_IN_LIST = r"^ ?[/,&] ?\w"
FIELD_SEPARATOR = r"^ {0,3}[:–—-] *"
#: Spellings that become one, in this order.
SPELLINGS = (
    ("[’‘]", "'"), (r"[ \t\n\r\f\x0B\xA0]+", " "), (r"\bu\. ?s\b\.?", "us"), (r"\bh-1b", "h1b"), (r"\bh1-b", "h1b"), (r"\bcannot\b", "can not"), (r"\bcan't\b", "can not"),
    (r"\bwon't\b", "will not"), (r"n't\b", " not"), (r"\bat all\b", "atall"),
)
#: Of each spelling, what every text that has it has; none where it is in any text.
SPELLED = (("’", "‘"), (), ("u.",), ("h-1b",), ("h1-b",), ("cannot",), ("can't",), ("won't",), ("n't",), ("at all",))
#: How many words may stand between: a negation and what it negates, two negations, a quantifier, an offering verb, a hedge.
REACH, DOUBLE, BOUND, OFFERING, HEDGED = 8, 4, 6, 5, 3
SCOPE, WINDOW = 160, 120
PATTERN = E.alternation(RULES)
#: Each match of PATTERN has one of the first, each of SIGNAL and of TRANSFER one of the others; no match of PATTERN has a full stop.
NEEDS = ("sponsor", "citizen", "permanent resident", "green card", "gc only", "visa", "perm process", "exempt", "immigration", "h1b transfer")
OF_SIGNAL, OF_TRANSFER = ("sponsor", "visa", "immigration", "work authorization", "h1b", "green card", "perm"), ("transfer", "exempt")

CLASSES = ("negative", "negated_offer", "unsettled", "unreachable", "scope_limit", "ambiguous", "export_control", "hedged", "positive")


def with_normalised(df: DataFrame, text: Column, name: str, *keep: str) -> DataFrame:
    """``keep`` and ``text`` in one spelling, as ``name``. Each spelling is a column of its own on the way, sought by pattern only in texts that have its cue."""
    at = df.select(*keep, F.translate(F.coalesce(text, F.lit("")), E.UPPER, E.LOWER).alias(name))
    for (pattern, to), cues in zip(SPELLINGS, SPELLED, strict=True):
        new = F.regexp_replace(name, pattern, to)
        at = at.withColumn(name, F.when(E.has_any(F.col(name), cues), new).otherwise(F.col(name)) if cues else new)
    return at


def _framed(s: Column) -> Column:
    """A span with the clause before it, the sentence before it, the clause after it and the predicate after it."""
    near, right = F.substring(s.left, -SCOPE, SCOPE), F.substring(s.right, 1, SCOPE)
    opens = near.rlike(rf"{JOIN}$") & F.concat(s.phrase, F.substring(right, 1, 60)).rlike(rf"^{TOPIC_VERB}")
    return F.struct(
        s.at.alias("at"), s.phrase.alias("phrase"), E.of_phrase(RULES, s.phrase, "name").alias("rule"), E.of_phrase(RULES, s.phrase, "kind").alias("kind"),
        F.when(opens, "").otherwise(E.after_last(near, BREAK)).alias("scope"), E.after_last(s.left, SENTENCE).alias("head"), E.before_first(right, BREAK).alias("tail"),
        E.before_first(F.regexp_replace(right, FIELD_SEPARATOR, ""), AHEAD).alias("predicate"), E.before_first(s.right, SENTENCE).alias("rest"), right.alias("right"),
        F.concat(F.substring(s.left, -WINDOW, WINDOW), s.phrase, F.substring(s.right, 1, WINDOW)).alias("window"),
    )


def _weighed(s: Column) -> Column:
    """A framed span with the conditions that decide, each evaluated once."""
    bare = lambda g: E.few_tokens(g, DOUBLE) & ~g.rlike(TOPIC) & ~g.rlike(E.COORDINATOR)
    near = lambda p: E.near_right(s.tail, p, BOUND) | (s.has_cue & E.near_left(s.gap, p, BOUND))
    no_denial = ((s.kind == "field") & s.right.rlike(DENIED_FIELD)) | ((s.kind == "list") & s.right.rlike(MORE_IN_LIST))
    no_denial = no_denial | ((s.kind == "person") & s.right.rlike(ESCAPE) & ~s.phrase.rlike("must be an? us citizen")) | ((s.kind == "verb") & ~s.window.rlike(IMMIGRATION))
    return F.struct(
        s.at.alias("at"), s.phrase.alias("phrase"), s.rule.alias("rule"), s.kind.alias("kind"), no_denial.alias("no_denial"),
        (s.about & near(EACH)).alias("limited"), (s.about & near(ALL)).alias("either"), (s.about & near(NEW_PETITION)).alias("new_only"),
        (s.has_cue & bare(s.gap)).alias("negated"), (s.outside.rlike(CUE) & bare(E.after_last(s.outside, CUE))).alias("doubled"), s.reached.alias("reached"),
        (s.reached & s.gap.rlike(VERB) & E.few_tokens(E.after_last(s.gap, VERB), OFFERING)).alias("verb"),
        F.when(~s.predicate.rlike(CUE), "none").when(E.near_right(s.predicate, CUE, REACH), "reachable").otherwise("unreachable").alias("ahead"),
        (s.about & s.sentence.rlike(EXPORT) & ~s.sentence.rlike(CONTEXT)).alias("licence"), (~s.window.rlike(CONTEXT)).alias("aside"),
        ((F.trim(s.scope) != "") & s.head.rlike(CUE) & ~E.after_last(s.head, CUE).rlike(HARD)).alias("stranded"),
        (E.near_left(s.scope, HEDGE, HEDGED) | E.near_right(s.tail, HEDGE, HEDGED) | s.head.rlike(CONDITION)).alias("maybe"),
    )


def _clauses(s: Column) -> Column:
    """A framed span with its nearest negation and its sentence."""
    keep = [s[c].alias(c) for c in ("at", "phrase", "rule", "kind", "scope", "head", "tail", "predicate", "right", "window")]
    gap = E.after_last(s.scope, CUE)
    return F.struct(
        *keep, gap.alias("gap"), s.scope.rlike(CUE).alias("has_cue"), (s.scope.rlike(CUE) & E.few_tokens(gap, REACH)).alias("reached"), s.phrase.rlike(r"\bsponsor").alias("about"),
        F.regexp_extract(s.scope, rf"^(.*)(?:{CUE})", 1).alias("outside"), F.concat(s.head, s.phrase, s.rest).alias("sentence"),
    )


def _graded(s: Column, transfer_friendly: Column) -> Column:
    """What a weighed span says: one of CLASSES, or ``none``."""
    by_quantifier = lambda otherwise: F.when(s.limited, "scope_limit").when(s.either, "unsettled").otherwise(otherwise)
    denial = F.when(s.negated, "ambiguous").otherwise(by_quantifier(F.when(s.no_denial, "none").when(s.new_only & transfer_friendly, "unsettled").otherwise("negative")))
    mention = F.when(s.verb, F.when(s.doubled, "ambiguous").otherwise(by_quantifier(F.lit("negative")))).when(s.ahead == "reachable", denial).otherwise("none")
    offer = (
        F.when((s.kind == "weak") & s.aside, "none").when(s.reached & s.doubled, "ambiguous").when(s.reached, by_quantifier(F.lit("negated_offer"))).when(s.stranded, "unreachable")
        .when(s.ahead == "unreachable", "unreachable").when(s.ahead == "reachable", by_quantifier(F.lit("negated_offer"))).when(s.maybe, "hedged").otherwise("positive")
    )
    said = F.when(s.kind == "head", mention).when(s.kind.isin("strong", "weak"), offer).otherwise(denial)
    return F.struct(s.at.alias("at"), s.phrase.alias("phrase"), s.rule.alias("rule"), F.when(s.licence & (said != "none"), "export_control").otherwise(said).alias("says"))


def _said(spans: str, kind: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: s.says == kind), lambda s: F.concat(s.rule, F.lit(": "), s.phrase))))


def _headed(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat(F.lit(kind + " "), x))


def assessed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` and decision, verdict, confidence, rule_ids, evidence and signature for each row; one projection after another, no shuffle."""
    at = E.with_spans(with_normalised(df, F.col(text), "t", *keep), "t", PATTERN, "s", ".", NEEDS)
    at = at.withColumn("transfer", E.has_any(F.col("t"), OF_TRANSFER) & F.col("t").rlike(TRANSFER))
    for step in (_framed, _clauses, _weighed, lambda s: _graded(s, F.col("transfer"))):
        at = at.withColumn("s", F.transform("s", step))
    at = at.withColumns({c: _said("s", c) for c in CLASSES})
    at = at.withColumn("unsettled", F.array_except("unsettled", F.array_union("negative", "negated_offer")))
    some = {c: F.size(c) > 0 for c in CLASSES}
    settled = some["negative"] | some["negated_offer"]
    conflict = (settled | some["unsettled"] | some["unreachable"]) & (some["positive"] | some["hedged"])
    open_ = some["unsettled"] | some["ambiguous"]
    by = lambda yes, no, low, none: F.when(conflict, low).when(settled, no).when(open_, low).when(some["positive"], yes).when(F.size("s") - F.size(F.filter("s", lambda s: s.says == "none")) > 0, low).otherwise(none)
    lists = F.concat(*[_headed(c) for c in CLASSES])
    families = F.concat_ws(",", *[F.when(some[c], c) for c in sorted(CLASSES)])
    at = at.select(
        *keep, by("match", "no_match", "review", "review").alias("decision"), by("likely", "unlikely", "unknown", "unknown").alias("verdict"),
        by("high", "high", "low", "unknown").alias("confidence"), F.array_join(lists, " | ").alias("evidence"), families.alias("families"), (some["negative"] | (families != "") | (E.has_any(F.col("t"), OF_SIGNAL) & F.col("t").rlike(SIGNAL))).alias("signal"),
    )
    material = F.concat_ws("|", F.lit("sponsorship"), "decision", "verdict", "confidence", "families")
    return at.withColumn("signature", F.substring(F.sha2(material, 256), 1, 16))
