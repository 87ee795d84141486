"""Small dictionaries. Lists marked as fixed values must equal the reference's for equal results."""

from __future__ import annotations

import unicodedata


def _pairs(text: str) -> dict[str, str]:
    return dict(tuple(part.strip() for part in line.split("=", 1)) for line in text.strip().splitlines())


# Terms that mark a comment as using slang.
SLANG_TERMS = """
lol lmao lmfao lmk rofl omg wtf btw imo imho tbh smh fyi idk irl brb af rn dm rt ngl fr bc tho thru ppl plz thx
u ur y r b4 gr8 m8 2day 2nite tmr tmrw asap aka fomo goat sus lowkey highkey gtfo stfu jk ikr tfw mfw yolo fam
bro sis gonna wanna gotta kinda sorta dunno cuz w/ w/o pov rip ftw gg wp ez op lit salty savage flex stan simp
based ratio copium hopium oof yeet bet cap bussin periodt tea shade slay queen king w l
""".split()

# Slang and its translation in the two live cleaning variants.
SLANG = _pairs("""
lol=laugh out loud
lmao=laughing
lmfao=laughing
haha=laughing
lmk=let me know
rofl=laughing
omg=oh my god
wtf=what the fuck
btw=by the way
imo=in my opinion
imho=in my humble opinion
tbh=to be honest
smh=shaking my head
fyi=for your information
idk=i do not know
irl=in real life
brb=be right back
af=as fuck
rn=right now
dm=direct message
rt=retweet
ngl=not gonna lie
fr=for real
bc=because
tho=though
thru=through
ppl=people
plz=please
thx=thanks
u=you
ur=your
y=why
r=are
b4=before
gr8=great
gonna=going to
wanna=want to
gotta=got to
""")

# What the notebook variants translate on top of the above.
NOTEBOOK_SLANG = SLANG | _pairs("""
m8=mate
2day=today
2nite=tonight
tmr=tomorrow
tmrw=tomorrow
asap=as soon as possible
aka=also known as
fomo=fear of missing out
goat=greatest of all time
sus=suspicious
lowkey=somewhat
highkey=very
gtfo=get the fuck out
stfu=shut the fuck up
jk=just kidding
ikr=i know right
tfw=that feeling when
mfw=my face when
yolo=you only live once
fam=family
bro=brother
sis=sister
kinda=kind of
sorta=sort of
dunno=do not know
cuz=because
pov=point of view
rip=rest in peace
ftw=for the win
gg=good game
wp=well played
ez=easy
op=overpowered
lit=amazing
salty=upset
savage=brutal
flex=show off
stan=support
simp=obsessed
based=authentic
ratio=more engagement
copium=denial
hopium=hope
oof=expression of pain
yeet=throw
bet=okay
cap=lie
bussin=really good
slaps=really good
vibe=feeling
mood=relatable
same=i agree
facts=truth
periodt=end of discussion
tea=gossip
shade=disrespect
slay=do great
queen=amazing woman
king=amazing man
w=win
l=loss
""")

# Stop words and negations of the topic variant.
STOP_WORDS = """
the a an and or but in on at to for of with by from as is was are were be been being have has had do does did
will would should could may might must can shall this that these those
""".split()
NEGATIONS = "not no never neither nobody nothing nowhere".split()

# Contracted negations that the notebook variants also turn into "not".
NOTEBOOK_NEGATIONS = NEGATIONS + """
dont don't wont won't isnt isn't arent aren't wasnt wasn't werent weren't hasnt hasn't havent haven't hadnt hadn't
doesnt doesn't didnt didn't wouldnt wouldn't shouldnt shouldn't couldnt couldn't cant can't mustnt mustn't
""".split()

# Boilerplate words dropped before texts are matched, in order.
BOILERPLATE = "description question prompt text analysis facts fact issue holding conclusion rule citation".split()

# US state codes.
STATES = _pairs("""
AL=alabama
AK=alaska
AZ=arizona
AR=arkansas
CA=california
CO=colorado
CT=connecticut
DE=delaware
FL=florida
GA=georgia
HI=hawaii
ID=idaho
IL=illinois
IN=indiana
IA=iowa
KS=kansas
KY=kentucky
LA=louisiana
ME=maine
MD=maryland
MA=massachusetts
MI=michigan
MN=minnesota
MS=mississippi
MO=missouri
MT=montana
NE=nebraska
NV=nevada
NH=new hampshire
NJ=new jersey
NM=new mexico
NY=new york
NC=north carolina
ND=north dakota
OH=ohio
OK=oklahoma
OR=oregon
PA=pennsylvania
RI=rhode island
SC=south carolina
SD=south dakota
TN=tennessee
TX=texas
UT=utah
VT=vermont
VA=virginia
WA=washington
WV=west virginia
WI=wisconsin
WY=wyoming
DC=washington dc
""")

# Country codes of two and three letters.
COUNTRIES = {
    code: name
    for codes, name in _pairs("""
US USA=united states
UK GB GBR=united kingdom
CA CAN=canada
CN CHN=china
JP JPN=japan
DE DEU=germany
FR FRA=france
IT ITA=italy
ES ESP=spain
AU AUS=australia
BR BRA=brazil
IN IND=india
RU RUS=russia
MX MEX=mexico
KR KOR=south korea
AR ARG=argentina
ZA ZAF=south africa
SA SAU=saudi arabia
TR TUR=turkey
PL POL=poland
NL NLD=netherlands
BE BEL=belgium
SE SWE=sweden
NO NOR=norway
DK DNK=denmark
FI FIN=finland
IE IRL=ireland
PT PRT=portugal
GR GRC=greece
CH CHE=switzerland
AT AUT=austria
NZ NZL=new zealand
SG SGP=singapore
HK HKG=hong kong
IL ISR=israel
EG EGY=egypt
NG NGA=nigeria
KE KEN=kenya
PH PHL=philippines
TH THA=thailand
VN VNM=vietnam
MY MYS=malaysia
ID IDN=indonesia
PK PAK=pakistan
BD BGD=bangladesh
UA UKR=ukraine
""").items()
    for code in codes.split()
}

# Emoticons that are plain text, in the reference's order. Two of its patterns hold a bare "^"
# in the middle and never match; they are left out here, and the one for "^_^" counts twice.
EMOTICONS = [
    "¯\\_(ツ)_/¯", "(ツ)", "ಠ_ಠ", "ಠ益ಠ", "ʘ‿ʘ", "(╯°□°)╯︵ ┻━┻", "┬─┬ノ( º _ ºノ)", "ᕕ( ᐛ )ᕗ", "^_^",
    "٩(◕‿◕｡)۶", "(づ｡◕‿‿◕｡)づ", "ლ(ಠ益ಠლ)", "¯\\_(シ)_/¯", "(⌐■_■)", "(╥_╥)", "(T_T)", "T_T", "o_o", "O_O",
    ">_<", "^_^", "XD", "xD", ":D", "=D", ":]", ":[", ":(", ":)", ";)", ";D",
]
# The two emoticons with a repeated part, as patterns.
EMOTICON_PATTERNS = [r"\._.+", r";_;+"]

# Keyword lists of the rule scorer.
HATE_WORDS = "hate kill die stupid idiot dumb racist nazi".split()
OFFENSIVE_WORDS = "damn hell crap ass suck wtf stfu".split()
POSITIVE_WORDS = "love great amazing good happy thank please".split()
MACHINE_PHRASES = [
    "as an ai", "language model", "i apologize", "i cannot", "furthermore", "moreover", "in conclusion",
    "it is important to note", "delve into", "utilize", "commence", "facilitate", "comprehensive",
]
FORMAL_WORDS = "however nevertheless therefore thus hence consequently".split()

# Symbols dropped when they stand alone.
LONE_SYMBOLS = "• ◦ ▪ ▫ · ※ → ← ↑ ↓ ✓ ✗ ★ ☆ ♦ ♥ ♠ ♣".split()

# Emojis whose usual name is not that of the Unicode character.
EMOJI_NAMES = [
    ("😍", "smiling_face_with_heart-eyes"), ("🙏", "folded_hands"), ("👍", "thumbs_up"), ("👎", "thumbs_down"), ("❤", "red_heart"),
    ("😡", "enraged_face"), ("👏", "clapping_hands"), ("👀", "eyes"), ("💪", "flexed_biceps"), ("💯", "hundred_points"),
    ("🏻", "light_skin_tone"), ("🏼", "medium-light_skin_tone"), ("🏽", "medium_skin_tone"),
    ("🏾", "medium-dark_skin_tone"), ("🏿", "dark_skin_tone"),
]


def emoji_names() -> list[tuple[str, str]]:
    """(emoji, name) of every pictograph: the fixed names, else the Unicode name in lower case with underscores; flags by
    their two letters. A default for callers without a table of their own."""
    fixed, out = dict(EMOJI_NAMES), []
    for first, last in ((0x2190, 0x2BFF), (0x1F004, 0x1F0CF), (0x1F170, 0x1F251), (0x1F300, 0x1FAFF)):
        for code in range(first, last + 1):
            char = chr(code)
            name = fixed.get(char) or unicodedata.name(char, "").lower().replace(" ", "_")
            if name and unicodedata.category(char) in ("So", "Sk", "Sm"):
                out.append((char, name))
    letters = [chr(0x1F1E6 + i) for i in range(26)]
    out += [(a + b, f"flag_{chr(65 + i)}{chr(65 + j)}") for i, a in enumerate(letters) for j, b in enumerate(letters)]
    return out


# Contracted forms and their expansions, as (pattern, replacement), applied in order.
CONTRACTIONS = [
    (r"(?i)\bcan't\b", "cannot"),
    (r"(?i)\bwon't\b", "will not"),
    (r"(?i)\bshan't\b", "shall not"),
    (r"(?i)\bain't\b", "are not"),
    (r"(?i)\blet's\b", "let us"),
    (r"(?i)\by'all\b", "you all"),
    (r"(?i)\b(do|does|did|would|should|could|is|are|was|were|has|have|had|must|might|need|dare)n't\b", "$1 not"),
    (r"(?i)\bi'm\b", "I am"),
    (r"(?i)\b(you|we|they|who|what|there)'re\b", "$1 are"),
    (r"(?i)\b(i|you|he|she|it|we|they|that|this|there|who|what)'ll\b", "$1 will"),
    (r"(?i)\b(i|you|we|they|who|would|should|could|might|must)'ve\b", "$1 have"),
    (r"(?i)\b(i|you|he|she|it|we|they|that|there|who)'d\b", "$1 would"),
    (r"(?i)\b(he|she|it|that|this|there|here|what|where|who|when|how|why)'s\b", "$1 is"),
]

# Contractions the lexicon variant expands or strips once quotes are gone.
LATE_CONTRACTIONS = {"cannot": "can not"}


def latin_folding() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter, and those letters (from the Unicode tables)."""
    source, target = [], []
    for first, last in ((0xA0, 0x24F), (0x1E00, 0x1EFF)):
        for code in range(first, last + 1):
            char = chr(code)
            plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
            if len(plain) == 1:
                source.append(char)
                target.append(plain)
    for char, plain in zip("øØđĐðÐłŁıħĦŧŦ‘’“”‐‑–−´ʼ‚„", "oOdDdDlLihHtT''\"\"----'',\""):
        source.append(char)
        target.append(plain)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = latin_folding()
# Letters and marks whose ASCII form is longer than one character.
FOLD_LONG = [("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th"),
             ("—", "--"), ("…", "..."), ("«", "<<"), ("»", ">>"), ("€", "EUR"), ("£", "PS"), ("©", "(c)"), ("®", "(r)")]

# Letters of other scripts and their usual ASCII spelling, as pairs in the order of the alphabet.
CYRILLIC = ("а a б b в v г g д d е e ё io ж zh з z и i й i к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh "
            "щ shch ъ ' ы y ь ' э e ю iu я ia є ie і i ї i ґ g ў u ђ dj ј j љ lj њ nj ћ tsh џ dzh")
GREEK = "α a β b γ g δ d ε e ζ z η e θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ u φ ph χ kh ψ ps ω o"
HEBREW = "א a ב b ג g ד d ה h ו v ז z ח kh ט t י y ך k כ k ל l ם m מ m ן n נ n ס s ע ` ף p פ p ץ ts צ ts ק q ר r ש sh ת t"
ARABIC = ("ا a أ a إ i آ a ب b ة h ت t ث th ج j ح h خ kh د d ذ dh ر r ز z س s ش sh ص s ض d ط t ظ z ع ` غ gh ف f ق q ك k ل l "
          "م m ن n ه h و w ى a ي y ء ' ؤ w ئ y پ p چ ch ژ zh ک k گ g ی y")
# Syllables whose spelling is not that of the Unicode name.
KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji"}
SCRIPTS = r"[\x{0370}-\x{052F}\x{0590}-\x{06FF}\x{0900}-\x{097F}\x{3040}-\x{30FF}\x{FF10}-\x{FF5A}]"


def script_letters() -> dict[str, str]:
    """One letter of another script to its ASCII spelling: Cyrillic, Greek, Hebrew and Arabic from the tables, with accents
    and capitals by decomposition; Devanagari, kana and wide forms from the Unicode names and numbers."""
    out: dict[str, str] = {}
    for table in (CYRILLIC, GREEK, HEBREW, ARABIC):
        parts = table.split()
        out |= dict(zip(parts[::2], parts[1::2]))
    out |= {k.upper(): v.capitalize() for k, v in out.items() if len(k.upper()) == 1 and k.upper() != k}
    for code in [*range(0x370, 0x530), *range(0x590, 0x700), *range(0x900, 0x980), *range(0x3040, 0x3100), *range(0xFF10, 0xFF5B)]:
        char = chr(code)
        name, kind = unicodedata.name(char, ""), unicodedata.category(char)
        base = unicodedata.normalize("NFKD", char)[:1]
        last = name.rsplit(" ", 1)[-1].lower()
        if char in out or not name:
            continue
        if kind == "Nd":
            out[char] = str(unicodedata.digit(char))
        elif base in out or base.isascii():
            out[char] = out.get(base, base)
        elif name.startswith("DEVANAGARI LETTER"):
            out[char] = last[:-1] if len(last) > 1 and last.endswith("a") and last != "aa" else last
        elif name.startswith("DEVANAGARI VOWEL SIGN"):
            out[char] = last
        elif name.startswith(("HIRAGANA LETTER", "KATAKANA LETTER")):
            out[char] = KANA.get(last, last)
        elif kind in ("Mn", "Mc", "Lm", "Cf") or "PROLONGED SOUND" in name:
            out[char] = ""  # marks that have no sound of their own
    return out
