"""Canonical rewritings of names that people typed: the rules, for single strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

from corpusloom.functions.words import fold

#: Given names (folded) and what those who bear them are called.
NICKNAMES = """
aleksander: alek alex sasha sascha olek; anastasia: nastya stasia ana; andre: dede; antonio: tono toni tony; benjamin: ben benny benji
elizabeth: betty liz lizzie beth eliza lisa bess libby; emeric: imre; esteban: teban; francisco: paco pancho kiko; friedrich: fritz fred freddy
giuseppe: beppe pino peppe; gregor: greg grischa; guillermo: memo guille; heinrich: heinz heiner; ingrid: inga; isabella: bella isa izzy
johannes: jo hannes hans johan; jorg: jorgi; jose: pepe chepe; joseph: joe joey jo sepp; josephine: jo josie fifi; katharina: kat kathi kati katja
lawrence: larry laurie; ludmila: mila luda lida; magdalena: lena magda leni; margaret: maggie peggy meg greta madge; michael: mick mike mickey micha
nikolai: kolya nick niko klaus; oskar: ossi; patricia: pat patty trish tricia; piotr: piotrek petya; quentin: quin; richard: rick dick rich ricky
robert: rob bob bobby robbie bert; sebastian: seb basti bastian; theodore: theo ted teddy; tobias: tobi toby; ulrike: uli ulli rike; valerie: val
viola: vi; wilhelmina: mina willa minnie billie; william: bill will billy willy liam; xavier: xavi javi; yusuf: yus; zoltan: zoli; wanda: wandi
thomas: tom tommy; james: jim jimmy jamie; john: jack johnny; charles: charlie chuck; edward: ed eddie ned; alexander: alec xander; christopher: chris kit
daniel: dan danny; matthew: matt; samuel: sam sammy; nicholas: nico; peter: pete; catherine: cathy kate katie; susan: sue susie; dorothy: dot dolly
dolores: lola; frederick: freddie; gerhard: gerd; andreas: andi; manuel: manolo; ignacio: nacho; inaki: inas; marie: mimi; rainer: rai; bernard: bernie
david: dave davey; stephen: steve; steven: steve; jennifer: jenny jenn; timothy: tim timmy; anthony: tony; andrew: andy drew; kenneth: ken kenny
ronald: ron ronnie; donald: don donnie; gregory: greg; jeffrey: jeff; philip: phil; phillip: phil; raymond: ray; vincent: vince vinny; walter: walt wally
leonard: len lenny; gerald: gerry jerry; jacob: jake; joshua: josh; zachary: zach zack; nathaniel: nate nathan; douglas: doug; arthur: art artie
harold: harry hal; henry: hank harry; albert: al bertie; alfred: alf alfie; barbara: barb babs; deborah: deb debbie; rebecca: becky becca; victoria: vicky tori
judith: judy; pamela: pam; sandra: sandy; cynthia: cindy; jessica: jess jessie; abigail: abby gail; gabriela: gabi; eleonora: nora; maximilian: max; konstantin: kostja
wolfgang: wolfi; rudolf: rudi; ludwig: lutz; matthias: matze hias; stefan: steff; enrique: quique; eduardo: lalo edu; alejandro: ale jandro; concepcion: concha
rosario: charo; mercedes: merche; pilar: pili; rafael: rafa; santiago: santi chago; salvatore: totò turi; francesco: cecco; domenico: mimmo; luigi: gigi
charlotte: lottie lotte charlie; dmitri: dima mitya; mikhail: misha; vladimir: vova volodya; yekaterina: katya; tatiana: tanya; jean: jeannot; jacques: jacquot; dominique: domi
"""


def letters(token: str) -> str:
    """A folded token with one spelling for transliterated vowels; in long ones a doubled vowel counts as a slip."""
    return token.replace("ae", "a").replace("oe", "o").replace("ue", "u").replace("aa", "a") if 3 < len(token) <= 8 else token


#: Nicknames and given names in the spelling that typed tokens are brought to.
GIVEN_OF: dict[str, list[str]] = {}
for _entry in re.split(r"[;\n]", NICKNAMES):
    if ":" in _entry:
        _given, _called = _entry.split(":")
        for _nick in _called.split():
            GIVEN_OF.setdefault(letters(fold(_nick)), []).append(letters(_given.strip()))

#: Titles, little words and legal forms to leave out, and spellings of words that organisations are made of.
TITLES = frozenset("dr prof mr mrs ms miss mme mlle sir frau herr sr sra dipl ing phd md jr".split())
LITTLE = frozenset("the of for and de la le du der die das fur et y und".split())
LEGAL = frozenset("gmbh ltd limited inc llc llp plc ag corp corporation incorporated sarl sas sa bv nv oy oyj ab asa aps kg kgaa ohg mbh ug ev co company pty spa srl kk sl slu lda ltda zrt kft doo sro".split())
ORGANISATION_WORDS = {
    "institute": "institute inst institut instituto", "foundation": "foundation found fdn fndn stiftung fondation", "university": "university univ uni u universitat universite",
    "cooperative": "cooperative coop cooperativa", "society": "society soc", "sons": "sons", "laboratories": "laboratories labs lab laboratory", "international": "international intl int",
    "association": "association assoc assn", "college": "college coll", "department": "department dept", "academy": "academy acad", "centre": "centre center ctr",
}
#: Short forms of words that organisations are named by.
SHORT_FOR = {
    "mfg": "manufacturing", "manuf": "manufacturing", "eng": "engineering", "engg": "engineering", "mgmt": "management", "svc": "services", "svcs": "services", "tech": "technology",
    "natl": "national", "dev": "development", "bros": "brothers", "grp": "group", "hosp": "hospital", "govt": "government", "comm": "commission", "bd": "board", "res": "research", "sys": "systems",
}
WORD_OF = {spelling: word for word, spellings in ORGANISATION_WORDS.items() for spelling in spellings.split()}
KINDS = frozenset(ORGANISATION_WORDS)
#: Kinds that say too little with a single word: what the organisation works on is missing.
PARTIAL = frozenset(("sons", "institute", "foundation", "laboratories"))
#: A word so many times as rare as another may be its slip, however often it occurs, and so many times one two slips away.
RARER, RAREST = 10, 50
QUOTED = re.compile(r"[\"“”„«»‘'(][^\"“”„«»()']*[\"“”»’')]")
DOTTED_FORM = re.compile(r"\b(?:[a-z]\.){2,}[a-z]?\b\.?")
BRACKETED = re.compile(r"\(([A-Z]{2,5})\)")


def deletions(word: str, most: int) -> set[str]:
    """The word and what is left of it without up to ``most`` of its letters."""
    out = {word}
    layer = {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def typing_errors(a: str, b: str, most: int = 3) -> int:
    """Letters left out, added, replaced, or swapped with the next (optimal string alignment); ``most`` if more."""
    if abs(len(a) - len(b)) >= most:
        return most
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row, before, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) >= most:
            return most
    return min(row[-1], most)


def rewrite(name: str) -> tuple[str, list[str], list[str]]:
    """(kind, tokens, weak keys) of a name.

    Kind is ``full`` (a given name and a surname, or an organisation) with its canonical tokens, or ``weak`` with keys
    ``prefix|token`` under which the full name may be found: an initial, a nickname of several names, a bare or
    prefixed surname, an abbreviated word, an acronym. Kind is empty for strings without letters.
    """
    acronym = BRACKETED.search(name)
    text = BRACKETED.sub(" ", name)
    text = re.sub(r"(?<=\w)-(?=[^\W\d_])", lambda m: " " if text[m.end() : m.end() + 1].isupper() and not text.isupper() else "", text)
    plain = fold(QUOTED.sub(" ", text) if text.count('"') or "“" in text else text)
    plain = DOTTED_FORM.sub(lambda m: m[0].replace(".", "") + " ", plain)
    raw = re.findall(r"[^\W\d_]+\.?", plain.replace("'", ""))
    if not raw:
        return "", [], []
    words = [(w.rstrip("."), w.endswith(".")) for w in raw]
    organised = [w for w, _ in words if w in WORD_OF and w not in ("u", "int", "lab")] or [w for w, _ in words if w in LEGAL and w != "co"]
    if organised or acronym or "u. of" in plain or "&" in name or "+" in name:
        return _organisation(words, acronym)
    tokens = [(letters(w), dot) for w, dot in words if w not in TITLES and w != "the"]
    long = [(w, dot) for w, dot in tokens if len(w) > 1]
    single = [w for w, _ in tokens if len(w) == 1]
    if len(long) >= 3 and (len(tokens) > 3 or any(w in LITTLE for w, _ in long) or any(dot for _, dot in long)):
        return _organisation(words, acronym)
    if not long:
        return "", [], []
    given = [w for w, _ in long]
    if len(given) == 1:
        only = given[0]
        if single:
            return "weak", [], [f"i:{single[0]}|{only}"]
        keys = [f"s:|{only}"]
        if name.strip().isupper() and 3 <= len(only) <= 5:
            keys.append(f"c:|{''.join(sorted(only))}")  # the initials of an organisation, perhaps
        if name.strip().islower() and len(only) > 5 and " " not in name.strip():
            keys.append(f"i:{only[0]}|{only[1:]}")
        return "weak", [], keys
    if len(given) > 2:
        return "full", sorted(set(given)), []
    known = [(i, GIVEN_OF[w]) for i, w in enumerate(given) if w in GIVEN_OF]
    if known:
        i, names = known[0]
        if len(names) == 1:
            return "full", sorted({names[0], given[1 - i]}), []
        return "weak", [], [f"n:{g}|{given[1 - i]}" for g in names]
    return "full", sorted(set(given)), []


def _organisation(words: list[tuple[str, bool]], acronym: re.Match | None) -> tuple[str, list[str], list[str]]:
    kept, short = [], []
    for w, dot in words:
        if w in LITTLE or w in LEGAL or w in TITLES:
            continue
        if w in WORD_OF:
            kept.append(WORD_OF[w])
        elif w in SHORT_FOR:
            kept.append(SHORT_FOR[w])
        elif dot and len(w) <= 5:
            short.append(w)
        else:
            kept.append(letters(w))
    kept = sorted(set(kept))
    if not kept:
        return "", [], []
    own = [w for w in kept if w not in KINDS]
    if acronym and own:
        kinds = " ".join(w for w in kept if w in KINDS)
        return "weak", [], [f"a:{kinds}:{''.join(sorted(acronym[1].lower()))}|{' '.join(own)}"]
    if short:
        return "weak", [], [f"t:{short[0][:4]}:{' '.join(x for x in kept if x != w)}|{w}" for w in own]  # as far as it is written
    if len(kept) == 1:
        return "weak", [], [f"s:|{kept[0]}"]
    kinds = [w for w in kept if w in KINDS]
    if len(own) == 1 and set(kinds) <= PARTIAL:
        return "weak", [], [f"k:{' '.join(kinds)}|{own[0]}"]
    return "full", kept, []


def full_keys(tokens: list[str]) -> Iterator[str]:
    """The weak keys under which a full name may be found."""
    own = [t for t in tokens if t not in KINDS]
    organised = len(own) < len(tokens) or len(tokens) > 2
    if not organised and len(tokens) == 2:
        for a, b in (tokens, tokens[::-1]):
            yield f"i:{a[0]}|{b}"
            yield f"n:{a}|{b}"
            yield f"s:|{b}"
        return
    if 3 <= len(tokens) <= 5:
        yield f"c:|{''.join(sorted(t[0] for t in tokens))}"
    kinds = " ".join(t for t in tokens if t in KINDS)
    for t in own:
        rest = [x for x in own if x != t]
        if kinds and (rest or "international" in tokens):
            yield f"k:{' '.join(x for x in tokens if x in PARTIAL)}|{t}"
        if rest and kinds:
            yield f"a:{kinds}:{''.join(sorted(x[0] for x in rest))}|{t}"
        for s in rest:
            for written in (3, 4):
                yield f"t:{s[:written]}:{' '.join(x for x in tokens if x not in (s, t))}|{t}"


def near_forms(tokens: list[str]) -> set[str]:
    """Forms of which two names share one if up to two typing errors part them, wherever these fall."""
    out = set()
    for i, t in enumerate(tokens):
        rest = " ".join(tokens[:i] + tokens[i + 1 :])
        out |= {f"{rest}|{v}" for v in deletions(t, 2 if len(t) > 4 else 1)}
    ranked = sorted(range(len(tokens)), key=lambda i: -len(tokens[i]))[:3]
    for x, i in enumerate(ranked):
        for j in ranked[x + 1 :]:
            rest = " ".join(t for k, t in enumerate(tokens) if k not in (i, j))
            for v in deletions(tokens[i], 1):
                out |= {f"{rest}|{min(v, w)}|{max(v, w)}" for w in deletions(tokens[j], 1)}
    return out


def same_but_for_typing(a: list[str], b: list[str], a_seen: list[int], b_seen: list[int], established: int) -> int:
    """Typing errors between two canonical token lists, 3 if they are different names.

    Tokens that both occur in ``established`` names or more are words of their own, not slips of one another, unless one is ``RARER``
    times as rare as the other: in a larger corpus every slip of a common word recurs. One that occurs once, or is ``RAREST`` times as
    rare, may be two slips away from an established one.
    """
    left = [(t, n) for t, n in zip(a, a_seen) if t not in b]
    right = [(t, n) for t, n in zip(b, b_seen) if t not in a]
    if len(left) != len(right) or len(left) > 2:
        return 3
    ways = [list(zip(left, right))] + ([list(zip(left, right[::-1]))] if len(left) == 2 else [])
    best = 3
    for way in ways:
        total = 0
        for (t, n), (u, m) in way:
            slips = typing_errors(t, u)
            rare = max(n, m) >= (established if min(n, m) == 1 else RAREST * min(n, m)) and min(len(t), len(u)) > 3
            limit = 2 if rare or min(len(t), len(u)) > 7 else 1
            own = min(n, m) >= established and max(n, m) < RARER * min(n, m)
            total += 3 if slips > limit or own else slips
        best = min(best, total)
    return min(best, 3)
