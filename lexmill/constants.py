"""Fixed numbers and word lists of the engine, in one place."""

from __future__ import annotations

# BM25
K1, B = 1.5, 0.75
TOP_K = 8
# candidates of the first phase: OVERSAMPLE * k, at least OVERSAMPLE_LEAST
OVERSAMPLE, OVERSAMPLE_LEAST = 32, 256
# second phase
COVERAGE_WEIGHT = 0.8
EXACT_STEP, EXACT_MOST = 0.25, 0.75
COHERENCE_STEP, COHERENCE_MOST = 0.05, 0.30
SCORE_THRESHOLD = 0.2
SEGMENT_LEAST = 8
CONVERSATION_BOOST = 1.5
CONVERSATION_SCORE, DECAY_SCORE, DECAY_HOURS = 15.0, 10.0, 24.0

# chunking, in bytes
CHUNK_BYTES, DYNAMIC_CHUNK_BYTES = 15000, 5000
BYTES_PER_TOKEN = 4

# keywords
WORD_LEAST, WORD_MOST = 3, 30
BIGRAM_MOST_LENGTH, BIGRAMS_PER_CHUNK = 61, 50
KEYWORD_CAP = 200
NEIGHBOUR_KEYWORDS = 5
SIGNATURE_SIZE = 64
TF_MOST = 65535

# text
SNIPPET_BYTES = 200
CONTEXT_CHARS = 32000
CONTEXT_WINDOW, CONTEXT_WINDOW_MOST = 1, 3
PAGE_SIZE, PAGE_SIZE_MOST = 100, 1000
LRU_TURNS = 20
GUIDE_SUMMARIES = 100
CHAT_KEYWORDS = 20
SCANNER_CANDIDATES, SCANNER_KEEP, SCANNER_CHARS, SCANNER_BATCH = 64, 8, 2000, 8
JUDGE_CHARS = 300
RERANK_CHARS = 512
REFINE_ROUNDS = 3

# (least number of chunks, top k)
TIERS = [(0, 3), (10**2, 8), (10**3, 10), (10**4, 13), (10**5, 17), (10**6, 24), (5 * 10**6, 30), (10**7, 40), (10**8, 70), (10**9, 100), (10**10, 150)]

# Words of two letters that are keywords all the same.
SHORT_WORDS = frozenset(
    """
    ai bp co db dc dj eu gp hr id io ip it la ml nj ny os pc ph pr qa sf tv ui uk un us ux vs
    """.split()
)

# Words that are none, in the order of their last letters.
STOP_WORDS = frozenset(
    """
    had did old could should would and made see she the make like some one are here there where were more these those use have being each which much such
    with both all well will them from can than been then when who too also into her other after over their for our your has was does his this its that what
    get let not most just but out about you new how now may say way they only many very
    """.split()
)

# Words that may stand inside a name.
NAME_CONNECTORS = frozenset("al and bin de del di el for ibn in la le mac mc of on st the van von".split())

# Capitalised words that begin no name, in the order of their last letters.
NO_NAMES = frozenset(
    """
    had could should would and the while some are here there where were before these those whose have above being during each which much through with both
    shall will whom from can than been between then when who also into under either neither other after over their for has was this that what might not
    most just must but about how below may they only many very every
    """.split()
)

# Phrases by which a question is about the one who asks: heads with "i", "me" and "my", and what follows "my" and "i".
_BEFORE_I = "you said|did|where did|when did|who did|what did|how did|why did|could|should|would|were|have|will|when will|what will|how will|why will|am|where am|when am|who am|what am|how am|why am|can|how can|do|where do|when do|what do|how do|why do|was|where was|when was|who was|what was|how was|why was|might|may".split("|")
_BEFORE_ME = "recall|remember|what do you know about".split("|")
_BEFORE_MY = "who are|what are|what were|regarding|what's|what was|where is|who is|what is|whats|about|tell me about".split("|")
_AFTER_MY = """
job|music|dad|husband|friend|girlfriend|boyfriend|food|mood|bird|preference|wife|age|movie|turtle|style|game|name|home|phone|type|horse|house|spouse
favorite|guinea pig|dog|fish|health|book|work|email|mom|room|children|opinion|profession|medication|occupation|condition|son|laptop|car|career|father
mother|brother|partner|character|daughter|sister|hamster|computer|doctor|kids|friends|hobbies|allergies|feelings|books|illness|address|pets|thoughts
parents|interests|cat|pet|height|weight|rabbit|restaurant|apartment|sport|interest|show|birthday|hobby|family|personality
""".strip().replace("\n", "|").split("|")
_AFTER_I = """
read|watched|studied|worked|traveled|emailed|called|mentioned|learned|visited|texted|lived|moved|played|said|sold|heard|met|bought|went|told you|saw
""".strip().replace("\n", "|").split("|")
SELF_PHRASES = sorted(
    {f"{x} i" for x in _BEFORE_I}
    | {f"{x} me" for x in _BEFORE_ME}
    | {f"{x} my" for x in _BEFORE_MY}
    | {f"my {x}" for x in _AFTER_MY}
    | {f"i {x}" for x in _AFTER_I}
    | {"me ", "i ", "my ", "we talked", "mine", "myself", "our conversation", "what did we discuss", "what did we talk about", "tell me what you know"}
)
