"""Word lists, weights and patterns that define the scores."""

# Verbs by cognitive level; a verb of several levels counts at its highest.
BLOOM = {
    1: "define duplicate list memorize recall repeat reproduce state name identify recognize retrieve locate match label recite record relate underline",
    2: "classify describe discuss explain identify indicate locate recognize report select translate paraphrase summarize interpret compare infer illustrate outline restate review rewrite show give",
    3: "apply choose demonstrate dramatize employ illustrate operate schedule sketch solve use implement execute practice calculate compute construct manipulate modify produce relate show write",
    4: "analyze appraise calculate categorize compare contrast criticize differentiate discriminate distinguish examine experiment question test break inspect investigate separate subdivide survey deduce deconstruct",
    5: "appraise argue assess attach choose compare defend estimate judge predict rate support value critique evaluate justify prioritize conclude recommend select rank weigh measure verify",
    6: "arrange assemble collect compose construct create design develop formulate manage organize plan prepare propose generate produce hypothesize invent author combine compile devise integrate revise",
}
# Keywords by depth of knowledge, likewise.
DOK = {
    1: "define list name identify recall recognize state repeat match label memorize locate find count compute recite tell who what when where",
    2: "describe explain summarize classify compare interpret use organize estimate infer predict show apply solve calculate illustrate sort distinguish categorize relate extend make",
    3: "analyze evaluate justify critique formulate investigate assess develop revise support argue differentiate construct examine hypothesize determine cite explain phenomena draw conclusions synthesize",
    4: "design create produce compose generate propose conduct research synthesize integrate prove invent document gather plan debate collaborate critique across multiple",
}
# Words of higher-order and lower-order demands.
HOTS = (
    "analyze analyse differentiate distinguish compare contrast categorize categorise classify examine investigate inspect deconstruct breakdown separate discriminate experiment "
    "evaluate assess appraise argue critique criticize criticise judge justify support defend challenge rank prioritize prioritise weigh recommend conclude verify "
    "design create construct formulate generate produce hypothesize hypothesise invent compose develop synthesize synthesise integrate devise propose plan organize organise"
).split()
LOTS = (
    "define list name identify recall recognize recognise state repeat match label memorize memorise locate find recite retrieve "
    "describe explain summarize summarise paraphrase indicate report select translate outline review"
).split()
# Quantifiers, negations, question words.
QUANTIFIERS = "all some any every none few many most each both either neither several no".split()
NEGATIONS = "no not never neither nor nobody nothing nowhere without barely hardly scarcely seldom".split()
WH_SCORES = {"who": 1.0, "where": 1.0, "when": 1.0, "which": 1.0, "what": 0.7, "why": 0.4, "how": 0.4}
# Response burden by the first matching group.
OPEN_CREATE = "write create design construct compose invent produce build generate develop formulate plan propose".split()
OPEN_ANALYSE = "why how justify argue discuss evaluate assess analyze analyse critique investigate examine compare contrast synthesize synthesise interpret reflect elaborate".split()
OPEN_EXPLAIN = "explain describe summarize summarise outline illustrate demonstrate clarify define characterize characterise".split()
OPEN_WH = "what who which when where".split()
OPEN_AUX = "is are was were do does did can could will would should has have".split()
# Wording flaws.
LEADING = [
    r"\bdon't you (think|agree|believe|feel)\b", r"\bwouldn't you (say|agree|expect)\b", r"\bisn't it (true|the case|obvious)\b",
    r"\bsurely\b", r"\bobviously\b", r"\bclearly\b", r"\bof course\b",
]
LOADED = (
    "terrible awful horrible disgusting outrageous shameful wonderful magnificent excellent superb perfect fantastic ridiculous absurd unacceptable devastating "
    "catastrophic revolutionary groundbreaking disastrous tragic"
).split()
VAGUE = "often sometimes rarely occasionally frequently usually generally seldom regularly commonly".split()
SQP_WEIGHTS = {"double_barrel": 0.40, "leading": 0.35, "loaded": 0.15, "vague": 0.10}
# Part markers; the outer word boundaries are part of the definition.
PART_MARKER = r"\b(part\s+[a-z]|part\s+\d+|step\s+\d+|first[,\s]|second[,\s]|third[,\s]|finally[,\s]|\([a-z]\)|\([ivx]+\)|\d+\.)\b"
WH_AUX = r"\b(what|who|which|when|where|why|how|is|are|was|were|do|does|did|can|could|will|would|should|has|have)\b"
SUBORDINATORS = "although because since while if unless until after before as though whenever wherever once whereas whether".split()
CONJUNCTION_SUBORDINATORS = "although because since while if unless until after before as though whenever wherever once provided whereas whether even".split()
COORDINATORS = "and or but nor so yet for".split()
# Stop words of the frequency metric.
ZIPF_STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into through that "
    "this these those it its i you he she we they what which who whom how why when where and but or nor not no so yet"
).split()
# Personal data.
EMAIL = r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b"
PHONE = r"\b(\+?1[-.\s]?)?(\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
IDENT = r"\b(student|employee|id|s/n|sid|eid|uid|user)\s*#?\s*\d{4,}\b"
AGE = r"\b(\d{1,3}[-–]\s*year[-–]\s*old|\d{1,3}\s*years?\s*old|age\s+\d{1,3}|aged\s+\d{1,3})\b"
GENDER_K = "he she his her him hers male female man woman boy girl gentleman lady".split()
GENDER_DP = "he she his her him hers male female man woman boy girl".split()
MEDICAL_K = (
    "diagnosis diagnosed condition disease disorder syndrome patient symptom treatment medication therapy chronic acute surgery procedure cancer diabetes hypertension "
    "infection allergy allergic prescription"
).split()
MEDICAL_DP = "diagnosis diagnosed condition disease disorder syndrome patient symptom treatment medication therapy chronic cancer diabetes hypertension infection allergy allergic".split()
DP_BITS = {"person_name": 13.0, "age_specific": 7.0, "gender": 1.0, "medical_condition": 7.0, "employer": 5.0, "location_specific": 4.0, "group_membership": 3.0}

PRONOUNS = "i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves".split()

TAXONOMY = {
    "pedagogical": ["curriculum_alignment", "cognitive_demand", "concept_coverage", "response_burden"],
    "psychometric": ["difficulty", "discrimination", "guessing_careless", "distractor_functioning", "item_fit", "dimensionality", "reliability"],
    "linguistic_structural": ["readability", "linguistic_complexity", "ambiguity", "well_formedness", "diversity"],
    "fairness_ethics": ["group_bias", "measurement_invariance", "content_sensitivity", "harmful_content_risk", "privacy_risk"],
}
CRITICAL = ["harmful_content_risk", "privacy_risk"]


def levels(groups: dict[int, str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for k in sorted(groups):
        out |= dict.fromkeys(groups[k].split(), k)
    return out
