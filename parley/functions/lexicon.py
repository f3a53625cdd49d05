"""Word lists, patterns and limits that results depend on."""

from __future__ import annotations

# They must equal the published annotation and scoring conventions for results to agree.

BACKCHANNELS = ["ach so", "ah", "alles klar", "äh", "entschuldigung", "genau", "hm", "ja", "ja genau", "ja okay", "mhm", "ne", "okay", "ok", "richtig"]
SHORT_RESPONSES = "achso aha ah danke doch genau gut hm hmm ja jaja mhm ne nee nein ok okay richtig stimmt".split()
INCOMPLETE_FINAL = "als am an auf aber dann das dass dem den der die ein eine einem einen einer für im in ist kann mit oder und von wenn wie wird zu".split()
UNAMBIGUOUS_INCOMPLETE_FINAL = "als aber also am an auf das dass dem den der die ein eine einem einen einer für im mit ob obwohl oder und von weil wenn wie wo zu".split()
PARSER_INCOMPLETE_FINAL = "darf denke denken dürfte glaube glauben kann könnte mag meine meinen möchte muss müsste sage sagen soll sollte will würde".split()
DEPENDENT_INITIAL = "als dass falls indem nachdem ob obgleich obwohl seitdem sobald sofern solange während weil wenn wobei".split()
RESTARTS = "Aber Also Danke Danach Dann Das Dazu Du Er Es Genau Gut Hallo Haben Heute Ich Inwieweit Ja Jetzt Kann Können Man Möchten Nein Okay Sie Trifft Und Wann Warum Was Welche Welcher Welches Wem Wen Wer Wie Wieso Wir Wo Wodurch Womit Würden".split()
# Of RESTARTS, the words that need a finite verb among the next four; lower-case words that start a sentence too, how
# near that verb has to be, and the words of which the next must be one (none: any); the words a question starts with; what a
# question's second part may be; what is an abbreviation before a full stop.
VERBAL_RESTARTS = "Du Er Es Man Sie Und".split()
LOWER_RESTARTS = [
    ("wie", 4, "auch häufig ist oft sind viel"),
    ("warum wieso", 4, ""),
    ("wann was wer wo", 1, ""),
    ("du er es ich man sie wir", 4, ""),
    ("also danach dann jetzt", 4, ""),
]
QUESTION_WORDS = "wann warum was wer wie wieso wo".split()
QUESTION_GOES_ON = "ADJ DET NOUN PRON PROPN".split()
ABBREVIATED = "bzw ca d dr prof usw z".split()
JOINING = ",:;/-–—("

NEGATION_CUES = "nicht nichts nie niemals niemand nirgends nirgendwo kein keine keinen keinem keiner keines nein nee weder ohne".split()
YES_NO = "ja nein nee jein jo jep doch".split()
ENGLISH = "the and you we is are of to this that it have what with would be for my your yes yeah yep i do can they there about like".split()
STOP_WORDS = """der die das den dem des ein eine einen einem einer eines und oder aber ich du er sie es wir ihr mir mich dir
dich ihm ihn uns euch ist sind war waren bin bist hat habe hab haben hatte hatten wird werden würde würden kann können muss
müssen soll sollen will wollen mal noch schon auch nur so ja nein nee ne doch also dann da hier wie was wo wer wenn weil dass
ob zu zum zur im in an am auf aus bei mit nach von vor für über um bis durch nicht kein keine gar sehr mehr eher genau gut ok
okay jetzt immer oft sich man sein ihre ihr ihren ihrem seine meine mein meinen gibt gerne gern alles alle etwas viel""".split()
SPELLING = {
    "okay": "ok", "nochmal": "noch mal", "erstmal": "erst mal", "dankeschön": "danke schön", "bitteschön": "bitte schön", "zurzeit": "zur zeit",
    "irgendwas": "irgend was", "tschau": "ciao", "tschüs": "tschüss", "gern": "gerne", "achso": "ach so",
}
ELISION = {
    "würd": "würde", "hab": "habe", "geh": "gehe", "glaub": "glaube", "hör": "höre", "les": "lese", "komm": "komme", "mach": "mache",
    "sag": "sage", "n": "ein", "nen": "einen", "nem": "einem", "ner": "einer", "s": "es", "gibts": "gibt es", "gehts": "geht es",
    "wars": "war es", "wär": "wäre", "hätt": "hätte", "find": "finde", "grad": "gerade", "grade": "gerade",
}
ISSUE_ELISION = ELISION | {"habs": "habe es", "ists": "ist es", "wirds": "wird es"}
ISSUE_SUFFIX = {"s": "es", "m": "dem"}
IMPERATIVES = "sag geh glaub hör les komm mach".split()
ENGLISH_APOSTROPHES = "it's that's what's let's there's here's".split()
ABBREVIATIONS = [
    (r"\bz\s?\.\s?b\.", "zum beispiel"), (r"\bd\.\s?h\.", "das heißt"), (r"\bu\.\s?a\.", "unter anderem"),
    (r"\bbzw\.?", "beziehungsweise"), (r"\busw\.?", "und so weiter"), (r"\bca\.", "circa"),
]
NUMBER_EXTRAS = ["eins", "hundert", "tausend", "million", "millionen"]

SENTENCE_FINAL = "[.!?…][\"'»”’)]*$"
OPENING = "\"'«»„“‚‘([{-–— \t"
CREDIT = r"(?:untertitel(?:ung)?(?:\s+des\s+zdf)?(?:\s*,?\s*(?:19|20)\d{2})?)"
ARTIFACTS = [rf"(?i){CREDIT}[,.!]?", r"(?i)©\s*.+", r"(?:19|20)\d{2}[.!]?", r"(?i)\[?(?:musik|pause|stille|unverständlich|unverständlich\s+\d+)\]?[.!]?"]
LIKERT = r"\btr\w{1,12}\s+(?:(?:er|es)\s+)?(?:gar\s+|eher\s+|überwiegend\s+)?(?:nicht\s+)?zu\b"
FILLER = "^(ä+h+m*|ö+h+m*|e+h+m+|h+m+|m+h+m*|m+|u+h+m*)$"
FILLER_TAG = r"\[(?:um+|uh+|hm+|mhm+|äh+m*|eh+m*)\]"
UNKNOWN_TAG = r"\[(unk\*?|unknown)\]"
FRAGMENT = r"(?<![\w-])[^\W\d_]{1,4}-(?=[\s,.;:?!]|$)"
VIDEO_GARBLE = r"\bvideo-?\s?t(?!elefonat)\w*|\btilfonat\w*"
ISSUE_WORD = r"\d+(?:[.,:]\d+)+|\w+(?:'\w*)?|'\w+|\[[^\]]*\]"

MAX_SENTENCE_TOKENS, MIN_SENTENCE_TOKENS, MAX_INTERRUPTION_TOKENS, MIN_REVIEW_TOKENS = 120, 2, 8, 4
NEAR_THRESHOLD, NEAR_MIN_TOKENS, SCRIPTED_INTERVIEWS = 0.92, 6, 3
MIN_ROLE_SAMPLE, POSITION_STRATA, OVERLAP_FRACTION = 10, 5, 0.10
RUN, MISS, MAX_WINDOW_S, MAX_GAP_S = 5, 0.8, 30.0, 2.0
ROLES, SPLITS = ("Interviewer", "Interviewee"), ("train", "val", "test")
