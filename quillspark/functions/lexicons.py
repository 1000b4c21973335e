"""Word lists, patterns and constants of the prose signals."""

from __future__ import annotations

# These lists, patterns and numbers define the signals; results depend on each of them.

ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st vs etc al ca cf eg ie dept est gen gov rep sen "
    "inc ltd co corp no vol fig pp ed eds rev approx min max ph sc ba ma md phd "
    "jan feb mar apr jun jul aug sep sept oct nov dec "
    "mon tue wed thu fri sat sun "
    "a.m p.m u.s u.k u.n e.g i.e a.d b.c"
).split()

FUNCTION_WORDS = sorted(set((
    "the a an this that these those some any no every each either neither "
    "i me my mine we us our ours you your yours he him his she her hers it its "
    "they them their theirs who whom whose which what "
    "is am are was were be been being have has had do does did "
    "will would shall should can could may might must ought need dare "
    "and or but nor for yet so as if then than because while although though "
    "unless until whether since whereas "
    "of to in on at by from with about against between into through during before after "
    "above below under over up down out off near upon among around across behind beyond "
    "not no none never very too also just only even still yet again ever almost "
    "i'm you're he's she's it's we're they're i've you've we've they've i'd you'd"
).split()))

VOCABULARY = [
    "leverage", "leveraging", "leveraged",
    "robust", "scalable", "innovative", "cutting-edge", "state-of-the-art",
    "seamless", "seamlessly", "synergy", "synergistic",
    "passionate", "thrilled", "honored", "delighted",
    "spearhead", "spearheaded", "spearheading",
    "pivotal", "transformative", "transformational", "paradigm",
    "unlock", "unleash", "empower", "empowering",
    "deep dive", "delve", "delving", "navigate the landscape",
    "ever-evolving", "fast-paced", "dynamic environment",
    "moreover", "furthermore", "additionally", "in essence",
    "in today's", "in the realm of", "at the intersection of",
    "look forward to", "would welcome the opportunity",
    "excited to discuss", "i'd love to discuss",
    "tapestry", "underscore", "underscores", "underscoring",
    "testament to", "speaks volumes",
]

HEDGES = [
    "generally", "always", "usually", "commonly", "strongly", "highly", "often",
    "worth noting that", "well-known that", "important", "recommended", "advisable",
    "crucial", "essential", "safe", "possible", "common", "normal", "natural", "typical",
]
BRIDGES = ["in other words", "to put it simply", "to put it another way", "put simply", "more specifically", "that is to say"]
LIMITERS = ["just", "only", "merely", "simply"]

EM_DASH = "—"
SMART_QUOTES = "“”‘’"
CLOSERS = "\"”’')]"
MATTR_WINDOW = 40
MIN_RELIABLE_WORDS = 20

VERDICTS = ("human", "mostly human, light tells", "AI-leaning", "reads as AI")
TOO_SHORT = "uncertain (text too short to score reliably)"
PROBABILITY_TIERS = (0.2, 0.5, 0.8)
