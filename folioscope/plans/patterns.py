"""Patterns of the rule engine, as Java regular expressions: label -> alternatives, in the order that decides."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results depend on each of these patterns and on their order.

NON_SCIENTIFIC = (
    r"\bthis (?:editorial|commentary|book review|letter to the editor)\b", r"\bin this issue\b", r"\bwe are pleased to (?:announce|introduce)\b",
    r"\bthe (?:editors?|editorial board) (?:of|welcome)\b", r"\breviewed? (?:the )?book\b", r"\bobituar", r"\berratum\b", r"\bcorrigendum\b",
    r"\bretraction notice\b", r"\bauthors? repl(?:y|ies)\b", r"\bresponse to (?:the )?(?:letter|commentary)\b",
)
EMPIRICAL = (
    r"\bparticipants? (?:were|completed|reported|comprised)\b", r"\bwe (?:recruited|surveyed|interviewed|enrolled|sampled|analy[sz]ed data)\b",
    r"\bdata were (?:collected|analy[sz]ed|drawn|obtained)\b",
    r"\ba (?:total|sample) of \d[\d,]* (?:participants|patients|adolescents|adults|respondents|cases|records|individuals|veterans|students)\b",
    r"\b(?:n\s*=\s*\d|sample size)\b", r"\bcross[- ]sectional (?:study|survey|design)\b", r"\blongitudinal (?:study|design|cohort)\b",
    r"\brandomi[sz]ed (?:controlled )?trial\b", r"\bretrospective (?:chart|cohort|record) review\b", r"\bregistry (?:data|linkage)\b",
    r"\bpsychological autops(?:y|ies)\b", r"\bsemi-?structured interviews?\b", r"\bfocus groups?\b", r"\bthematic analysis\b", r"\bgrounded theory\b",
    r"\bwe conducted (?:a|an|two|three)\b", r"\bresults? (?:showed|indicated|revealed|suggest)\b", r"\bodds ratios?\b", r"\bhazard ratios?\b",
    r"\bregression\b", r"\bp\s*[<>=]\s*0?\.\d", r"\b95%\s*(?:CI|confidence interval)\b",
)
NON_EMPIRICAL = (
    r"\bthis (?:paper|article|essay) (?:argues|proposes|offers|presents a (?:framework|model|theory)|considers|reflects)\b",
    r"\bconceptual (?:framework|analysis|paper|model)\b", r"\btheoretical (?:framework|paper|analysis|contribution)\b",
    r"\bwe (?:argue|propose a framework|theori[sz]e|reflect on)\b", r"\bnarrative review\b", r"\bcommentary\b", r"\bposition (?:paper|statement)\b",
    r"\bclinical (?:case )?vignette\b", r"\bpractice (?:guidance|reflection)\b", r"\bcall to action\b", r"\bviewpoint\b",
)
QUANTITATIVE = (
    r"\bregression\b", r"\blogistic\b", r"\bodds ratio\b", r"\bhazard ratio\b", r"\brisk ratio\b", r"\bchi[- ]squared?\b", r"\bANOVA\b", r"\bt-test\b",
    r"\bstructural equation model", r"\bmultilevel model", r"\blatent (?:class|profile|growth)\b", r"\bpropensity score\b", r"\btime[- ]series\b",
    r"\bpoisson\b", r"\bnegative binomial\b", r"\bsurvival analysis\b", r"\bcox (?:proportional|regression)\b", r"\bprevalence (?:of|rate)\b",
    r"\bincidence rate\b", r"\bstatistically significant\b", r"\bp\s*[<>=]\s*0?\.\d", r"\b95%\s*(?:CI|confidence interval)\b", r"\bmachine learning\b",
    r"\bpredictive model", r"\bAUC\b", r"\bpsychometric\b", r"\bfactor analysis\b", r"\bCronbach", r"\beffect size\b", r"\bcohen'?s d\b",
    r"\brandomi[sz]ed\b", r"\bcontrol(?:led)? (?:group|condition|trial)\b",
)
QUALITATIVE = (
    r"\bqualitative (?:study|design|analysis|methods?|interviews?|approach|research)\b", r"\bsemi-?structured interviews?\b", r"\bin-?depth interviews?\b",
    r"\bfocus groups?\b", r"\bthematic analysis\b", r"\bcontent analysis\b", r"\bgrounded theory\b", r"\bphenomenolog", r"\bethnograph",
    r"\bnarrative analysis\b", r"\bdiscourse analysis\b", r"\binterpretative phenomenological\b", r"\bIPA\b", r"\bconstant comparative\b",
    r"\bpurposive sampl", r"\bsaturation was reached\b", r"\bparticipants described\b", r"\bemergent themes?\b", r"\bcoded (?:the )?transcripts?\b",
    r"\blived experience\b", r"\bcase stud(?:y|ies)\b",
)
MIXED = (
    r"\bmixed[- ]methods?\b", r"\bqualitative and quantitative\b", r"\bquantitative and qualitative\b", r"\bconvergent (?:parallel )?design\b",
    r"\bexplanatory sequential\b", r"\bexploratory sequential\b", r"\btriangulat(?:ion|ed) (?:of )?(?:data|methods)\b",
)
REVIEW = (
    r"\bsystematic review\b", r"\bmeta-?analys[ie]s\b", r"\bmeta-?regression\b", r"\bscoping review\b", r"\brapid review\b", r"\bumbrella review\b",
    r"\bPRISMA\b", r"\bmeta-?synthesis\b", r"\bnetwork meta-?analysis\b", r"\bwe searched (?:PubMed|MEDLINE|Embase|PsycINFO|Web of Science|Scopus)\b",
    r"\b(?:studies|articles|records) were (?:screened|included|identified)\b", r"\bpooled (?:effect|estimate|prevalence|odds)\b",
    r"\binclusion and exclusion criteria\b",
)

PREVENTION_LEVEL = {
    "universal": (
        r"\buniversal (?:prevention|intervention|programme?|screening)\b", r"\bpopulation[- ]level (?:intervention|prevention|strategy)\b",
        r"\bpublic (?:health|awareness) campaign\b", r"\bmeans restriction\b", r"\bmedia guidelines?\b", r"\bschool[- ]based (?:universal|prevention) program",
    ),
    "selective": (r"\bselective (?:prevention|intervention)\b", r"\bat[- ]risk (?:group|population|youth|veterans)\b", r"\bhigh[- ]risk (?:group|population|sample)\b", r"\bgatekeeper training\b"),
    "indicated": (
        r"\bindicated (?:prevention|intervention)\b", r"\bsafety plan(?:ning)?\b", r"\bcrisis (?:line|text|hotline|服务)\b", r"\bbrief (?:contact|intervention) (?:after|following)\b",
        r"\bfollow[- ]up (?:contacts?|care) after (?:a )?suicide attempt\b", r"\bcaring (?:contacts|letters)\b",
    ),
    "treatment": (
        r"\b(?:CBT|DBT|CAMS|cognitive[- ]behavio(?:u)?ral therapy|dialectical behavio(?:u)?r therapy)\b", r"\bketamine\b", r"\bclozapine\b", r"\blithium\b",
        r"\bpharmacotherap", r"\bpsychotherap", r"\binpatient (?:treatment|admission)\b", r"\belectroconvulsive\b",
    ),
    "postvention": (r"\bpostvention\b", r"\bsuicide bereave", r"\bsurvivors of suicide loss\b", r"\bbereaved by suicide\b", r"\bafter(?:math|care) of a suicide\b"),
}
OUTCOME_CONSTRUCT = {
    "suicide_death": (r"\bsuicide (?:death|mortality|rate)s?\b", r"\bcompleted suicide\b", r"\bdied by suicide\b", r"\bsuicide[- ]related (?:death|mortality)\b", r"\bfatal self[- ]harm\b"),
    "suicide_attempt": (r"\bsuicide attempts?\b", r"\battempted suicide\b", r"\battempters?\b", r"\bnon-?fatal self[- ]harm\b"),
    "suicidal_ideation": (r"\bsuicidal ideation\b", r"\bsuicidal thoughts?\b", r"\bthoughts of suicide\b", r"\bdeath wish\b", r"\bpassive suicidal\b"),
    "non_suicidal_self_injury": (r"\bnon-?suicidal self-?injur", r"\bNSSI\b", r"\bself-?mutilat", r"\bself-?cutting\b"),
    "self_harm_undifferentiated": (r"\bself-?harm\b", r"\bdeliberate self-?harm\b", r"\bself-?poisoning\b"),
    "suicide_bereavement": (r"\bsuicide bereave", r"\bsuicide loss survivors?\b", r"\bbereaved by suicide\b", r"\bpostvention\b"),
    "attitudes_or_stigma": (r"\bstigma\b", r"\battitudes? toward", r"\bliteracy\b", r"\bknowledge and attitudes\b"),
    "service_use_or_care_process": (
        r"\bemergency department (?:visits?|presentations?)\b", r"\bservice (?:use|utili[sz]ation)\b", r"\bhelp[- ]seeking\b", r"\bcontinuity of care\b", r"\btreatment engagement\b", r"\breferral\b",
    ),
}
POPULATION = {
    "youth_adolescent": (
        r"\badolescents?\b", r"\byouths?\b", r"\bteenagers?\b", r"\bschool students?\b", r"\bchildren\b", r"\bcollege students?\b", r"\buniversity students?\b", r"\byoung (?:people|adults)\b",
    ),
    "older_adult": (r"\bolder adults?\b", r"\belderly\b", r"\bgeriatric\b", r"\blate[- ]life\b", r"\baged 65\b", r"\bseniors?\b"),
    "veteran_military": (r"\bveterans?\b", r"\bmilitary\b", r"\bservice members?\b", r"\bactive duty\b", r"\bsoldiers?\b", r"\bVeterans Health\b", r"\bVHA\b"),
    "clinical_psychiatric": (
        r"\bpsychiatric (?:inpatients?|patients?|admission)\b", r"\binpatient(?:s)?\b", r"\bmental health service users?\b", r"\bschizophrenia\b", r"\bbipolar\b", r"\bmajor depress",
    ),
    "primary_care": (r"\bprimary care\b", r"\bgeneral practi", r"\bfamily (?:medicine|physicians?)\b"),
    "justice_involved": (r"\bprison(?:ers?)?\b", r"\bincarcerat", r"\bjail\b", r"\bcorrectional\b", r"\bjustice[- ]involved\b", r"\bdetention\b"),
    "lgbtq": (r"\bLGBTQ?\+?\b", r"\bsexual minorit", r"\bgender minorit", r"\btransgender\b", r"\bgay\b", r"\blesbian\b", r"\bbisexual\b", r"\bnon-?binary\b"),
    "indigenous": (
        r"\bindigenous\b", r"\bAboriginal\b", r"\bNative American\b", r"\bAmerican Indian\b", r"\bFirst Nations?\b", r"\bMāori|Maori\b", r"\bAlaska Native\b", r"\bTorres Strait\b",
    ),
    "racial_ethnic_minority": (
        r"\bBlack (?:adults?|youth|Americans?)\b", r"\bAfrican American\b", r"\bLatin[oax]+\b", r"\bHispanic\b", r"\bAsian American\b", r"\bracial(?:/| and )ethnic (?:minorit|disparit)", r"\bethnic minorit",
    ),
    "rural": (r"\brural\b", r"\bremote (?:communit|area)", r"\bnon-?metropolitan\b"),
    "occupational": (
        r"\bfarmers?\b", r"\bphysicians?\b", r"\bnurses?\b", r"\bpolice officers?\b", r"\bfirst responders?\b", r"\bconstruction workers?\b", r"\boccupational (?:group|cohort)\b", r"\bworkplace\b",
    ),
    "perinatal": (r"\bperinatal\b", r"\bpostpartum\b", r"\bpregnan", r"\bmaternal\b"),
}
STUDY_DESIGN = {
    "rct": (r"\brandomi[sz]ed (?:controlled )?trial\b", r"\bRCT\b", r"\brandomly (?:assigned|allocated)\b", r"\bcluster[- ]randomi[sz]ed\b"),
    "quasi_experimental": (
        r"\bquasi-?experimental\b", r"\bpre-?post design\b", r"\bdifference[- ]in[- ]difference", r"\binterrupted time[- ]series\b", r"\bnon-?randomi[sz]ed (?:trial|controlled)\b",
    ),
    "cohort_prospective": (
        r"\bprospective cohort\b", r"\blongitudinal cohort\b", r"\bfollowed (?:up )?for \d+ (?:years?|months?)\b", r"\bbirth cohort\b", r"\bprospective(?:ly)? follow",
    ),
    "case_control": (r"\bcase-?control\b", r"\bmatched controls?\b", r"\bnested case-?control\b"),
    "cross_sectional": (r"\bcross-?sectional\b", r"\bsurvey of \d", r"\bnational survey\b", r"\bself-?report questionnaires?\b"),
    "ecological_timeseries": (
        r"\btime[- ]series\b", r"\becological (?:study|analysis)\b", r"\bjoinpoint\b", r"\bARIMA\b", r"\btrends? in suicide rates?\b", r"\bage-?period-?cohort\b",
    ),
    "registry_linkage": (
        r"\bregistry\b", r"\bregister[- ]based\b", r"\brecord linkage\b", r"\bnational registers?\b", r"\badministrative (?:data|claims)\b", r"\belectronic health records?\b", r"\bclaims data\b",
    ),
    "psychological_autopsy": (r"\bpsychological autops(?:y|ies)\b",),
    "systematic_review_meta_analysis": (r"\bsystematic review\b", r"\bmeta-?analys[ie]s\b", r"\bPRISMA\b"),
    "scoping_narrative_review": (r"\bscoping review\b", r"\bnarrative review\b", r"\bliterature review\b", r"\brapid review\b"),
    "simulation_modelling": (r"\bsimulation model", r"\bagent-?based model", r"\bmicrosimulation\b", r"\bcost-?effectiveness (?:model|analysis)\b", r"\bMarkov model"),
    "psychometric": (
        r"\bpsychometric propert", r"\bvalidat(?:ion|ing) (?:of )?(?:the )?(?:scale|instrument|measure)\b", r"\bfactor structure\b", r"\breliability and validity\b", r"\bconfirmatory factor analysis\b",
    ),
    "qualitative_interview": (r"\bsemi-?structured interviews?\b", r"\bin-?depth interviews?\b", r"\bfocus groups?\b"),
    "mixed_methods": MIXED,
}
SDOH_DOMAIN = {
    "economic_stability": (
        r"\bunemploy", r"\bpoverty\b", r"\bincome (?:inequality|level)\b", r"\bsocio-?economic (?:status|position|disadvantage)\b", r"\bfinancial (?:strain|hardship|difficult)", r"\bdebt\b",
        r"\brecession\b", r"\bausterity\b", r"\bjob (?:loss|insecurity)\b", r"\bemployment status\b", r"\bwelfare\b", r"\bminimum wage\b",
    ),
    "education_access": (r"\beducational attainment\b", r"\bschool (?:dropout|connectedness|climate)\b", r"\byears of (?:education|schooling)\b", r"\bacademic (?:pressure|stress)\b"),
    "healthcare_access": (
        r"\baccess to (?:mental health )?(?:care|services|treatment)\b", r"\bhealth insurance\b", r"\buninsured\b", r"\bMedicaid\b", r"\btreatment gap\b", r"\bunmet need\b",
        r"\bservice availability\b", r"\bworkforce shortage\b",
    ),
    "neighborhood_environment": (
        r"\bneighbo(?:u)?rhood\b", r"\bbuilt environment\b", r"\barea[- ]level deprivation\b", r"\bgreen space\b", r"\bcommunity disadvantage\b", r"\bsegregation\b", r"\bpopulation density\b",
        r"\bair pollution\b", r"\bheat|temperature\b",
    ),
    "social_community_context": (
        r"\bsocial (?:support|isolation|connect|capital|cohesion|network)\b", r"\blonelin", r"\bbelonging", r"\bfamily (?:conflict|cohesion)\b", r"\bbullying\b", r"\bpeer victimi[sz]ation\b",
        r"\badverse childhood experiences?\b", r"\bACEs?\b", r"\bintimate partner violence\b", r"\bmarital status\b",
    ),
    "discrimination_racism": (
        r"\bdiscriminat", r"\bracism\b", r"\bmicroaggress", r"\bminority stress\b", r"\bstructural racism\b", r"\bhomophobi|transphobi", r"\bhistorical trauma\b", r"\bcolonial",
    ),
    "housing_homelessness": (r"\bhomeless", r"\bhousing (?:instability|insecurity|eviction)\b", r"\beviction\b", r"\bforeclosure\b", r"\bunstably housed\b"),
    "food_insecurity": (r"\bfood insecurity\b", r"\bhunger\b", r"\bfood deserts?\b"),
    "incarceration": (r"\bincarcerat", r"\bprison\b", r"\bjail\b", r"\bcriminal justice\b", r"\bparole\b", r"\bprobation\b"),
    "immigration_status": (r"\bimmigrant", r"\bmigrant", r"\brefugee", r"\basylum seek", r"\bundocumented\b", r"\bacculturation\b"),
    "firearm_access_means": (
        r"\bfirearms?\b", r"\bgun (?:ownership|access|law|storage|violence)\b", r"\bmeans (?:restriction|safety)\b", r"\bsafe storage\b", r"\bpesticide (?:ban|restriction)\b", r"\bbarrier",
        r"\bpaacetamol|paracetamol pack\b",
    ),
    "digital_social_media": (
        r"\bsocial media\b", r"\bonline (?:communit|forum|content)\b", r"\binternet use\b", r"\bcyberbullying\b", r"\bsmartphone\b", r"\bdigital (?:intervention|technolog)\b",
        r"\bTikTok|Instagram|Twitter|Reddit\b",
    ),
}
MEANS_FOCUS = {
    "firearm": (r"\bfirearms?\b", r"\bgun\b", r"\bhandgun\b", r"\bshooting\b"),
    "poisoning_overdose": (r"\boverdose\b", r"\bself-?poison", r"\bintoxicat", r"\bparacetamol\b", r"\bacetaminophen\b", r"\bopioid\b", r"\bmedication ingestion\b"),
    "pesticide": (r"\bpesticides?\b", r"\bparaquat\b", r"\borganophosphat", r"\bherbicide\b"),
    "hanging": (r"\bhanging\b", r"\bstrangulat", r"\bsuffocat", r"\bligature\b"),
    "jumping": (r"\bjumping (?:from|off)\b", r"\bbridges?\b", r"\bfall from (?:a )?height\b", r"\bhigh[- ]rise\b"),
    "drowning": (r"\bdrowning\b",),
}

METHODS_HEADING = (r"\b(?:Methods?|Methodology|Design|Materials And Methods|Patients And Methods|Subjects And Methods|Procedure)\s*:",)
RESULTS_HEADING = (r"\b(?:Results?|Findings)\s*:",)
EMPIRICAL_MARKER = (
    r"\bn\s*=\s*\d", r"\bp\s*[<>=]\s*0?\.\d", r"\b95%\s*(?:CI|confidence)", r"\bodds ratio", r"\bhazard ratio", r"\bparticipants? were\b",
    r"\bwe (?:interviewed|surveyed|recruited|enrolled)\b", r"\bdata were (?:collected|analy[sz]ed)\b", r"\bsample of \d",
)
SYSTEMATIC_TEXT = (
    r"\bsystematic(?:ally)? (?:review|search|literature search)\b", r"\bmeta-?analy[sz]", r"\bPRISMA\b", r"\bscoping review\b", r"\bumbrella review\b",
    r"\bwe searched (?:PubMed|MEDLINE|Embase|PsycINFO|Web of Science|Scopus|CINAHL)\b", r"\b(?:studies|articles|records|trials) were (?:screened|included|identified|retrieved)\b",
    r"\bpooled (?:effect|estimate|prevalence|odds|OR|risk)\b", r"\binclusion (?:and exclusion )?criteria\b", r"\bPROSPERO\b", r"\brisk of bias\b", r"\bheterogeneity was assessed\b",
)
SYSTEMATIC_TAGS = ("systematic review", "meta-analysis", "scoping review", "network meta-analysis", "umbrella review")

NON_SCIENTIFIC_TAGS = (
    "editorial", "letter", "comment", "published erratum", "erratum", "retraction of publication", "retracted publication", "news", "newspaper article", "biography", "obituary",
    "bibliography", "directory", "interview", "video-audio media", "webcasts", "portrait", "legal case", "patient education handout", "address", "autobiography", "personal narrative",
    "congress", "introductory journal article", "book review", "paratext", "peer-review", "festschrift",
)
#: Tag, whether empirical, methodology; the first tag that a record has decides.
TAG_PRIORITY = (
    ("meta-analysis", True, "review"), ("systematic review", True, "review"), ("scoping review", True, "review"), ("randomized controlled trial", True, "quantitative"),
    ("qualitative research", True, "qualitative"), ("clinical trial", True, "quantitative"), ("controlled clinical trial", True, "quantitative"),
    ("pragmatic clinical trial", True, "quantitative"), ("observational study", True, "quantitative"), ("validation study", True, "quantitative"),
    ("evaluation study", True, "quantitative"), ("comparative study", True, "quantitative"), ("multicenter study", True, "quantitative"), ("twin study", True, "quantitative"),
    ("case reports", True, "qualitative"), ("editorial", False, None), ("comment", False, None), ("letter", False, None),
)

#: Dictionary, whether several labels may hold, and the label where none does (none: an empty list).
DICTIONARIES = {
    "prevention_level": (PREVENTION_LEVEL, False, "not_applicable"),
    "outcome_construct": (OUTCOME_CONSTRUCT, True, "not_specified"),
    "population": (POPULATION, True, "general_population"),
    "study_design": (STUDY_DESIGN, True, None),
    "sdoh_domain": (SDOH_DOMAIN, True, "none"),
    "means_focus": (MEANS_FOCUS, True, "none"),
}


def pattern(alternatives: tuple[str, ...]) -> str:
    """One Java pattern of the alternatives, without regard to case, Unicode-aware."""
    return "(?iU)" + "|".join(alternatives)


def branches(alternative: str) -> list[str]:
    """The parts of a pattern between the bars outside its groups."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(alternative):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(alternative[last:k])
            last = k + 1
    return [*out, alternative[last:]]


def required_literal(branch: str) -> str:
    """The longest run of letters that every match of a pattern holds, as lowered() shows it; empty if none is certain.

    A run that a pattern sets off by a word border begins or ends with a space.
    """
    runs, run, k = [], "", 0
    while k < len(branch):
        c = branch[k]
        size = 1
        letter = ""
        if c == "\\":
            size, letter = 2, "" if branch[k + 1].isalnum() else branch[k + 1]
        elif c == "[":
            size = branch.index("]", k) - k + 1
        elif c == "(":
            depth, j = 1, k + 1
            while depth:
                depth += (branch[j] == "(") - (branch[j] == ")")
                j += 1
            size = j - k
        else:
            letter = c
        after = branch[k + size : k + size + 1]
        if after == "{":
            repeat = branch[k + size : branch.index("}", k + size) + 1]
        else:
            repeat = after if after in ("?", "*", "+") else ""
        if c == "\\" and branch[k + 1] == "b":
            # a border takes no letter; the run before it ends with it, the next one begins with it
            runs.append(run + " ")
            run = " "
        elif not letter or repeat[:1] in ("?", "*") and repeat or repeat.startswith("{0"):
            runs.append(run)
            run = ""
        else:
            run += letter
            if repeat:
                runs.append(run)
                run = ""
        k += size + len(repeat)
    return max((_worded(r.lower()) for r in [*runs, run]), key=len)


def _worded(run: str) -> str:
    """A run with each series of signs as one space; a sign at its edge may stand next to others, so one space stands for it."""
    return re.sub(r"\W+", " ", run)


def lowered(text: Column) -> Column:
    """A text's lowered words, single spaces between and around them: a required literal stands in it wherever a pattern may match without regard to case."""
    t = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))  # which lower() makes two characters of
    t = F.replace(F.replace(t, F.lit("ſ"), F.lit("s")), F.lit("ı"), F.lit("i"))
    return F.concat(F.lit(" "), F.regexp_replace(t, "(?U)\\W+", " "), F.lit(" "))


#: Letters of a word's head.
HEAD = 5


def head(literal: str) -> str:
    """The head that some word of a text has wherever a literal stands in its lowered form; empty if none is certain.

    A word of the literal counts if it begins at a border; one shorter than a head must end at one too.
    """
    words = literal.split(" ")
    sure = [w for k, w in enumerate(words) if k and (len(w) >= HEAD or w and k < len(words) - 1)]
    return max(sure, key=len, default="")[:HEAD]


@cache
def known_heads() -> tuple[str, ...]:
    """The heads of all literals of this module's patterns."""
    stages = (NON_SCIENTIFIC, EMPIRICAL, NON_EMPIRICAL, QUANTITATIVE, QUALITATIVE, MIXED, REVIEW, SYSTEMATIC_TEXT, METHODS_HEADING, RESULTS_HEADING, EMPIRICAL_MARKER)
    every = [*stages, *(alternatives for dictionary, _, _ in DICTIONARIES.values() for alternatives in dictionary.values())]
    return tuple(sorted({h for alternatives in every for literal in _gated(alternatives) if (h := head(literal))}))


def heads(low: Column) -> Column:
    """Which known heads the words of a lowered text have: one pass over its words in place of a search for each literal."""
    return F.array_intersect(F.transform(F.split(low, " "), lambda w: F.substring(w, 1, HEAD)), F.array(*map(F.lit, known_heads())))


def worded(df: DataFrame, text: Column, name: str = "_text") -> tuple[DataFrame, tuple[Column, Column, Column]]:
    """With a text, its lowered form and its heads as columns, which are also returned; the patterns of many rules share them."""
    df = df.withColumn(name, text)
    df = df.withColumn(f"{name}_low", lowered(F.col(name)))
    df = df.withColumn(f"{name}_heads", heads(F.col(f"{name}_low")))
    return df, (F.col(name), F.col(f"{name}_low"), F.col(f"{name}_heads"))


def spelled_out(branch: str) -> list[str]:
    """A pattern that is one group between borders as a pattern for each of the group's alternatives; else the pattern itself."""
    found = re.fullmatch(r"(\\b)?\(\?:(.*)\)([^()?*+{][^()]*)?", branch)
    if not found:
        return [branch]
    depth = 0
    for c in found[2]:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return [branch]
    return [f"{found[1] or ''}{b}{found[3] or ''}" for b in branches(found[2])]


def required_signs(branch: str) -> str:
    """Signs of which every match of a pattern holds one; empty if none is certain."""
    if "(" in branch:
        return ""
    found = re.search(r"\[([<>=]+)\](?![?*{])", branch) or re.search(r"([<>=:])(?![?*{])", re.sub(r"\[[^]]*\]", "", branch))
    return found[1] if found else ""


def _gated(alternatives: tuple[str, ...]) -> dict[str, list[str]]:
    """Patterns by the literal that each needs; those without a telling one under the empty text."""
    gated: dict[str, list[str]] = {}
    for branch in (b for a in alternatives for b in branches(a)):
        for part in [branch] if len(required_literal(branch)) >= 3 else spelled_out(branch):
            literal = required_literal(part)
            gated.setdefault(literal if len(literal) >= 3 else "", []).append(part)
    return gated


def holds(text: Column, alternatives: tuple[str, ...], low: Column | None = None, heads: Column | None = None) -> Column:
    """Whether a pattern matches.

    Each alternative with a telling literal meets the text only where a plain search finds that literal, which is only
    looked for where the text's `heads`, if they're at hand, have its head; the few without one ask for a sign, if they
    need one, and are small patterns of their own.
    """
    return reduce(lambda x, y: x | y, [may & text.rlike(pattern(tuple(own))) for may, own in _asked(text, alternatives, lowered(text) if low is None else low, heads)])


def _asked(text: Column, alternatives: tuple[str, ...], low: Column, heads: Column | None) -> list[tuple[Column, list[str]]]:
    """Patterns with what a text must show for them to match."""
    gated = _gated(alternatives)
    always: dict[str, list[str]] = {}
    for branch in gated.pop("", []):
        always.setdefault(required_signs(branch), []).append(branch)
    out = []
    for literal, own in gated.items():
        known = head(literal)
        out.append((low.contains(literal) if heads is None or known not in known_heads() else F.array_contains(heads, known) & low.contains(literal), own))
    return [*out, *((reduce(lambda x, y: x | y, [text.contains(c) for c in signs]) if signs else F.lit(True), own) for signs, own in always.items())]


def hits(text: Column, alternatives: tuple[str, ...], low: Column | None = None, heads: Column | None = None) -> Column:
    """How many matches there are, from left to right without overlap. Alternatives that can't match are left out of a text's pattern, which changes no match."""
    low = lowered(text) if low is None else low
    may = {a: reduce(lambda x, y: x | y, [m for m, _ in _asked(text, (a,), low, heads)]) for a in alternatives}
    own = F.concat_ws("|", *(F.when(m, F.lit(a)) for a, m in may.items()))
    return F.when(own != "", F.regexp_count(text, F.concat(F.lit(pattern(("",))), own))).otherwise(0)
