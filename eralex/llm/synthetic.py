"""Invented documents with labelled personal data, to fit the field of ``personal``.

Sentences, names and places are made up for this module; slots in braces are filled by ``Maker``.
An entity of a document may come again: once in a sentence that tells what it is,
and in others (``EITHER``) where persons and things stand alike.
"""

from __future__ import annotations

import random
import re

LABELS = ["O", "email", "phone", "identity", "address", "name"]
O, EMAIL, PHONE, IDENTITY, ADDRESS, NAME = range(6)

#: Sentences in which {n} is plainly a private person.
PERSONS = """My client {n} never owned such a vehicle.|The cheque was drawn by {n} in favour of a dealer.|A nurse told {n} to wait outside.|{n}, who sells vegetables, heard the shot.|His sister {n} wept through the hearing.|Police arrested {n} and {n} before dawn.
Complaint lodged by {n}, {rel} {n}.|Accused No. {k}, {n}, stayed away from court.|PW {k} {n} turned away from the dock.|Mother of that infant, {n}, begged for time.|One {n} is said to have fled.|A boy named {n} brought the tea.|{h} {n} appeared in person.|The will favours {n} alone.
Wages due to {n} were never paid.|Dr. {n} stitched the wound.|The bail of {n} was cancelled.|{n} ({k} years) lives with an aunt.|{n} grumbled about a leaking roof.|Enquiries showed that {n} had sold the plough.|{n} confessed to nobody.|Her husband {n} drinks.|the widow of {n} asked for a pension
Written by {n}|Signed: {n}|Name of patient: {n}|Passenger {n} missed the ferry.|Our daughter {n} passed the examination.|Evidence of {n}, a mason, was brief.|Let {n} account for those stains.|{n} admits having lent the bicycle.|Blood was drawn from {n} by a lab assistant.|{n} and {n} quarrelled over a ditch.
{n}, aged about {k}, mends shoes.|If {n} is right, no lamp was lit.|Money passed from {n} to {n} twice.|A knife was found with {n} later.|{n} had borrowed seed.|The land was ploughed by {n} for years.|Nobody but {n} had the key.|Cross-examined, {n} faltered.|statement on oath of {n}|{n} deposed that it rained""".replace("\n", "|").split("|")
#: Sentences in which a person and a thing look alike.
EITHER = """{q} came first in the list.|They spoke of {q} for an hour.|{q} was not mentioned again.|Nothing more is known about {q}.|Then {q} moved to {p}.|We turn to {q} now.|There remains {q}.|All of this concerns {q} only.|{q} stood apart.|So much for {q}.|A word on {q} may be added.|{q} left an impression.|They had not forgotten {q}.""".split("|")
#: Sentences in which {x} is plainly no person.
THINGS = """The {x} Hotel was closed for repairs.|They bought shares of {x} Ltd.|Tickets to {x} cost Rs. {m}.|The factory of {x} Chemicals smells.|A bus of {x} Travels overturned.|The magazine {x} printed a rumour.|The village of {x} lies beyond the canal.|{x} Festival begins in spring.|The ship {x} sank off the coast.|The {x} Gazette reported hail.|Shares in {x} Cement fell.|{x} Co-operative Dairy sells milk.""".split("|")
PLACES_OF = """The family moved to {a} in the spring.|Goods were unloaded at {a} by torchlight.|Living at {a}.|{h} {n}, R/o {a}, is the buyer.|Her last known home is {a}.|Deliver to: {a}|The parcel for {a} came back unopened.|{n}, {rel} {n}, resident of {a}, objects.|a shop under the stairs of {a}|Letters to {a} were ignored.|They searched {a} twice.|An old couple owns {a}.|Add: {a}|The meter at {a} was sealed.""".split("|")
PHONES = """Please ring {t} after lunch.|Mob. {t}|Ph: {t}|Tel. {t}|Mobile No. {t} was switched off.|The SIM of {t} lay in a drain.|Whoever dialled {t} hung up.|Contact number {t}.|A text from {t} came late.|His phone {t} rang twice.|WhatsApp {t}|She saved {t} under a false entry.|call records for {t} came late|Fax and phone: {t}.|The caller used {t} for an hour.|{n}, mobile {t}, runs a stall.""".split("|")
MAILS = """Write to {e} for a copy.|E-mail: {e}|An invoice went to {e} instead.|{e} bounced.|The account {e} was frozen.|Kindly reply at {e}, failing which we shall act.|He used ({e}) to threaten them.|mail id {e}|Scans were attached and sent from {e} by mistake.|{n}, email {e}, keeps accounts.|<{e}>|Nobody opens {e} any more.|Login {e} was disabled.""".split("|")
NUMBERS = """Aadhaar {i}|PAN {i} is not linked.|Passport {i} had expired.|Voter card {i} was forged.|Driving licence {i} was impounded.|UID: {i}|ID {i}|The holder of {i} did not sign.|Proof of identity: {i}.|A photocopy of {i} was pinned up.|{n} (UID {i}) opened the locker.|Number {i} belongs to another resident.|They scanned {i} at the counter.|The clerk misread {i} twice.|His card, {i}, is torn.|The entry against {i} is blank.""".split("|")
#: Sentences and lines without a private person.
NONE = """Justice {s} dissented.|Mr. Justice {s} and Justice {s} concurred.|Before {g} {s}, Chief Justice|{s}, J. wrote for the court.|Hon'ble {h} Justice {g} {s}|as {s} J. put it long ago|In {s} v. State of {p} nobody raised it.|{nn} v. {nn}|{nn} vs. {f}|{f} v. {nn}|see {nn} v. {nn} ({y})|{f} v. {f} ({y})|{k}  {nn} v. {f}|{nn} v. {nn}    Appeal {k}/{y}|{f} v. {nn}  {k}|{UU} V. {UU}|{FF} V. {UU}|{UU} V. {FF}|{k}    {f} v. {f}
{f} built the dam.|A cheque of {f} was returned.|{f} is a tenant.|The permit of {f} lapsed.|Tender no. {k}/{y} worth Rs. {m}|Invoice {b8}|Case No. {k} of {y}|Writ Petition (Civil) No. {k} of {y}|FIR {k}/{y}|Crl. M.C. {k}/{y}|weighing {b5} kg|reference AB-{b8}|lot {b10} was spoiled|budget line {b4}|between Rs. {m} and Rs. {m}|Rs. 12,34,{b3}.00|cnr number {p4}{b12}|bar code {b12} of the carton|serial {b10}-{b2}|on {date}|dated {date} and {date}|{date}, {p}
Section {k}({k2}) of the Motor Vehicles Act, {y}|The Limitation Act, {y}, governs.|High Court of {p}|District and Sessions Court, {p}|Government of {p}|Ministry of Rural Roads|Form {k}, Schedule II|Annexure B to the Annual Report|First Information Report|Special Leave Petition|Learned Senior Advocate from {p}|Learned Additional Advocate General|Public Works Department, {p} Division|the Deputy Commissioner of Police, {p}|Mines and Minerals Rules, {y}|rule ({k}) shall apply|as sub-rule ({k}) demands|see clauses ({k}) and ({k2})|items ({k}) to ({k})|(see Table {k})|Central Bureau of Statistics|New {p} Municipal Corporation|the {s} Commission of {y}|the {s} Memorial Library|{s} Road was under water.|the plot, the flat and the lane|a colony of ants|the street was dark
CERTIFIED TRUE COPY|PAGE {k} OF {k}|NOT FOR CIRCULATION|Printed by the Copying Branch|Typed and checked by Branch Officer {k}|Share this page|All contents belong to the publisher, {y}|Website visited on {date}|Digitised from the old record room|END OF JUDGMENT|Reportable|Read out in court|ORDER|Heard.|Annexure P-{k}|Exhibit D-{k} bears no date.|Para {k}|{k}. {Lead} {say}|Penalty for short measure Any grocer who sells short|{w} of licences Every hawker who strays|{w} to arrest Whoever hides a deserter|Appeals An officer may prefer an appeal|{Lead} {w} {w2} applied""".replace("\n", "|").split("|")
_SUBJECTS = "a neighbour|the shopkeeper|one constable|the head nurse|a surveyor|the buyer|her employer|the broker|the lift operator|an auditor|the landlady|the second bidder|the warehouse owner|their accountant|the plumber|the railway clerk|the gatekeeper|the lessee|the mill|the society|the hawker|the patwari|a postman|the contractor|the cashier|the headmaster|the union|the sarpanch|counsel|the defendant|the plaintiff|the bailiff".split("|")
_VERBS = "signed|returned|lost|kept|posted|weighed|burnt|photographed|denied seeing|handed over|misplaced|copied|repaired|hid|mortgaged|painted|questioned|refused|counted|sealed|forged|bought|opened|described|stamped|inspected|valued".split("|")
_MEETS = "met|paid|sued|blamed|followed|hired|slapped|thanked|employed|recognised|divorced|rescued|cheated|visited|warned|nursed|robbed|named|overheard|reported|dismissed|acquitted|summoned|believed|attacked".split("|")
_WITH = "with|from|by|to|for|against|near|behind|of|belonging to|beside|without|and|between {n2} and|in the presence of|on behalf of|through|after|before|than".split("|")
_OBJECTS = "the ration card|a rent receipt|two sacks of rice|the spare key|the gate pass|an old photograph|the blue ledger|the boundary stones|a torn envelope|the meter reading|the cattle shed|the hand pump|a broken lamp|the family settlement|the wage sheet|a jute bag|the pump set|the sale notice|the X-ray plates|a promissory note|the site register|the seed bill|a carton of soap|the wall".split("|")
_TAILS = "before lunch|during the monsoon|after the fair|without asking anyone|at the bus depot in {p}|on {date}|for Rs. {m}|as the bridge near {p} was flooded|and went home|in {y}|though nobody complained|under clause {k} of the lease|with some delay|near {p}|since the offer of {date} had lapsed|while it rained|against a bond for Rs. {m}|overleaf".split("|")
_LEADS = "Thereafter,|Meanwhile,|In the evening,|Strangely enough,|Briefly,|By then|Yet|Later|Still,|As a rule,|Even so,|Of course,|Hence|Once more,|For years|At first|Quite often|Nevertheless,|That day|It seems certain that|We note that|Undoubtedly,|After a pause,|There is no doubt that|Moreover,".split("|")
_WORDS = "Grant|Power|Penalty|Recovery|Transfer|Seizure|Inspection|Notice|Revocation|Liability|Duty|Savings|Appeal|Levy|Custody|Registration|Adulteration|Trespass|Nuisance|Cheating".split("|")
PARTIES = """{n}|{n}|{n}|{n}|{n} & Ors.|{n} & Anr.|{n} and another|{n} and others|{h} {n}|{n}, {rel} {n}|Minor {n} through guardian {n}|{n}, R/o {a}|{n} resident of {a}|{n}, {t}|{n} ({t})|{n}, Ph: {t}|{n}, Mob. {t}|{n}, email {e}|{n} <{e}>|{n}, {e}|{n}, {i}|{n} (UID {i})|{n}, ID {i}|{f}|{f}, {a}|{f}, R/o {a}|{f} resident of {a}|{f}, {t}|{f} ({t})|{f}, Ph: {t}|{f}, Mob. {t}|{f}, email {e}|{f} <{e}>|{f}, {i}|{f} (UID {i})|{f}, ID {i}|{f}|{f}|{f}|Victim 'A'|Legal heirs, not traced|Identity masked|XYZ|{f}, {e}|{n} alias {g}""".split("|")

_ON = "b bh ch d dh g gh h j k kh l m n p r s sh t th v y br dr kr pr str z f gr".split()
_NUC = "a a a e i o u aa ee ai au".split()
_CODA = "n r l m t s k sh nd rt nt d v".split()
_GIVEN_END = "a i esh an it ya in ul ini am ek".split()
_SURNAME_END = "e i an ar al ad kar appa son wal ani esan ulu dar man ker eja ora esh ati ez ov une ath ale eri ode adi".split()
_FIRM = ["Traders", "& Sons", "Brothers", "Industries", "Textiles Ltd.", "Foundation", "Charitable Trust", "Pvt. Ltd.", "Steel Ltd.", "Associates", "& Co.", "Enterprises", "Sugar Mills Ltd.", "Transport Co.", "Finance Corporation", "Hospital", "Builders", "Agencies", "Foods Pvt. Ltd."]
_BODY = ["State of {p}", "Union Territory of {p}", "{p} Housing Board", "{p} Water Authority", "{p} University", "The Principal, {p} College", "The Collector, {p}", "Collector, {p} District", "The Tahsildar, {p}", "Municipal Corporation of {p}", "Gram Panchayat, {p}", "{p} Gramin Bank", "{p} Transport Corporation", "Regional Office, {p}", "Station House Officer, {p}", "{p} Electricity Co.", "The Secretary, Home Department", "Union of India", "The Superintendent of Stamps", "Ward No. {k} Welfare Association", "Block No. {k} Flat Owners Association", "Sector {k} Traders Forum", "Unit {k} Workers Union", "Excise Commissioner", "The Chairman, {p} Port"]
_WAYS, _AREAS = ["Road", "Street", "Lane", "Marg", "Avenue", "Cross", "Bazaar Road", "Main Road"], ["Towers", "Vihar", "Layout", "Colony", "Nagar", "Enclave", "Apartments", "Extension", "Quarters", "Heights", "Park"]
_AREA_NAMES = ["Green", "Rose", "Hill View", "River", "Sunrise", "Jasmine", "Officers", "Lake", "Gandhi"]
_MISREAD = {"o": "0", "l": "1", "s": "5", "i": "l", "e": "c", "m": "rn", "d": "cl", "u": "v", "h": "b"}


class Maker:
    """Fills slots and keeps labels."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.listed_given = [self._stem(2) + self.r.choice(_GIVEN_END) for _ in range(300)]
        self.listed_surnames = [self._stem(2) + self.r.choice(_SURNAME_END) for _ in range(300)]

    def _stem(self, most: int) -> str:
        r = self.r
        return "".join(r.choice(_ON) + r.choice(_NUC) + (r.choice(_CODA) if r.random() < 0.4 else "") for _ in range(r.randint(1, most)))

    def given(self) -> tuple[str, int]:
        if self.r.random() < 0.7:
            return self.r.choice(self.listed_given).title(), 1
        return (self._stem(2) + self.r.choice(_GIVEN_END)).title(), 0

    def surname(self) -> tuple[str, int]:
        if self.r.random() < 0.7:
            return self.r.choice(self.listed_surnames).title(), 2
        return (self._stem(2) + self.r.choice(_SURNAME_END)).title(), 0

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def place(self) -> str:
        return (self._stem(2) + self.r.choice(["pur", "garh", "bad", "ville", "pet", "ganj", "kot", "mora", "halli", "ton", "a", "i", ""])).title()

    def person(self, capitals: float = 0.12) -> list[tuple[str, int]]:
        """Words of a person with their list bits."""
        r, x = self.r, self.r.random()
        g, s = self.given(), self.surname()
        if x < 0.2:
            out = [(s[0] + ",", s[1]), g]
        elif x < 0.42:
            out = [*[(f"{c}.", 0) for c in r.sample("ABCDEGHIJKLMNPRSTUVY", r.choice([1, 2, 2]))], s]
        elif x < 0.47:
            out = [g, (f"{r.choice('ABCDGHKMNPRSTV')}.", 0), s]
        elif x < 0.5:
            out = [g, self.given(), s]
        else:
            out = [g, s]
        y = r.random()
        return [(w.upper(), b) for w, b in out] if y < capitals else [(w.lower(), b) for w, b in out] if y > 0.98 else out

    def firm(self) -> str:
        r = self.r
        if r.random() < 0.5:
            return r.choice(["", "", "M/s "]) + r.choice([self.surname()[0], self.place(), f"{self.given()[0]} {self.surname()[0]}"]) + " " + r.choice(_FIRM)
        return r.choice(_BODY).replace("{p}", self.place()).replace("{k}", str(r.randint(1, 200)))

    def address(self) -> str:
        r, n = self.r, self.r.randint(1, 420)
        way = f"{r.choice([*_AREA_NAMES, self.surname()[0], self.place(), self.place(), 'Church', 'Market', 'Tank', 'Club'])} {r.choice(_WAYS)}"
        area = f"{r.choice([*_AREA_NAMES, self.place(), self.given()[0]])} {r.choice(_AREAS)}"
        pin = r.choice([f"{self.digits(6)}", f"{self.digits(3)} {self.digits(3)}", f"- {self.digits(6)}", f"PIN {self.digits(6)}", f"PIN {self.digits(3)} {self.digits(3)}", ""])
        head = r.choice([f"Flat {n % 99}{r.choice('ABCD')}", f"Flat No. {n}", f"H.No. {n}", f"H.No. {n}-{n % 13}/{n % 9}", f"H. No. {n}/{n % 9}", f"House No. {n}", f"Plot No. {n}", f"Plot {n}, Sector {n % 60}", f"Door No. {n}", f"Door {n}", f"No. {n}", f"{n}", f"{n}/{n % 9}", f"{n}-{r.choice('ABC')}"])
        rest = [x for x in ([area, way] if r.random() < 0.45 else [area] if r.random() < 0.4 else [way])]
        a = f"{head}{r.choice([', ', ', ', ' '])}{r.choice(['', '', '', 'near ', 'opp. '])}{', '.join(rest)}"
        if r.random() < 0.85:
            a += f", {self.place()} {pin}"
        a = a.strip(" -")
        return a.upper() if r.random() < 0.2 else a

    def slot(self, k: str, entity: dict) -> tuple[list[tuple[str, int]], int]:
        r = self.r
        plain = lambda s: ([(w, 0) for w in s.split(" ")], O)
        if k in ("n", "x", "q"):
            if k in entity and (k == "q" or r.random() < 0.7):
                return entity[k]
            return (self.person(entity.get("capitals", 0.12)), NAME) if k != "x" else (self.thing(), O)
        if k in ("nn", "UU"):
            w = [self.given(), self.surname()]
            return ([(a.upper(), b) for a, b in w] if k == "UU" else w), O
        if k == "s":
            return [self.surname()], O
        if k == "g":
            return [self.given()], O
        if k in ("f", "FF"):
            f = self.firm()
            return plain(f.upper() if k == "FF" or r.random() < 0.25 else f)
        if k == "p":
            return plain(self.place())
        if k == "p4":
            return plain(self.place()[:4].upper())
        if k == "h":
            return plain(r.choice(["Shri", "Smt.", "Mr.", "Ms.", "Mrs.", "Kum.", "Dr.", "Sri"]))
        if k == "rel":
            return plain(r.choice(["s/o", "d/o", "w/o", "S/o", "D/o", "W/o", "son of", "daughter of", "wife of"]))
        if k == "y":
            return plain(str(r.randint(1950, 2025)))
        if k in ("k", "k2"):
            return plain(str(r.randint(1, 500 if k == "k" else 9)))
        if k == "m":
            return plain(f"{r.randint(1, 999)},{self.digits(3)}" if r.random() < 0.7 else f"{r.randint(1, 99)},{self.digits(2)},{self.digits(3)}")
        if k[0] == "b" and k[1:].isdigit():
            return plain(self.digits(int(k[1:])))
        if k == "date":
            d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(1960, 2025)
            month = "January February March April May June July August September October November December".split()[m - 1]
            return plain(r.choice([f"{d:02}.{m:02}.{y}", f"{d:02}-{m:02}-{y}", f"{d}/{m}/{y}", f"{d} {month} {y}", f"{d:02} {month} {y}", f"{y}-{m:02}-{d:02}"]))
        if k == "w":
            return plain(r.choice(_WORDS))
        if k == "w2":
            return plain(r.choice(_WORDS).lower())
        if k == "Lead":
            return plain(r.choice(_LEADS))
        if k == "say":
            return plain(f"{r.choice(_SUBJECTS)} {r.choice(_VERBS)} {r.choice(_OBJECTS)}.")
        if k == "t":
            a, b, c = self.digits(5), self.digits(5), self.digits(4)
            return [(w, 0) for w in r.choice([a + b, a + b, f"+91 {a} {b}", f"+91-{a}{b}", f"+91{a}{b}", f"0{self.digits(2)}-{self.digits(8)}", f"0{self.digits(3)}-{self.digits(7)}", f"0{self.digits(4)} {self.digits(6)}", f"({self.digits(3)}) {self.digits(3)}-{c}", f"0091 {self.digits(2)} {self.digits(4)} {c}", f"{self.digits(3)}.{self.digits(3)}.{c}", f"{a} {b}", f"{a}-{b}", f"{self.digits(3)}-{self.digits(3)}-{c}", f"{self.digits(4)} {self.digits(3)} {self.digits(3)}"]).split(" ")], PHONE
        if k == "i":
            letters = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
            return [(w, 0) for w in r.choice([f"{self.digits(4)} {self.digits(4)} {self.digits(4)}", f"{self.digits(4)}-{self.digits(4)}-{self.digits(4)}", self.digits(12), letters(5) + self.digits(4) + letters(1), letters(1) + self.digits(7), letters(3) + self.digits(7), f"{letters(2)}-{self.digits(2)}-{r.randint(1990, 2024)}-{self.digits(7)}", f"{letters(2)}{self.digits(2)} {r.randint(1990, 2024)}{self.digits(7)}"]).split(" ")], IDENTITY
        if k == "e":
            g, s = self.given()[0], self.surname()[0]
            who = r.choice([f"{g}{self.digits(2)}", f"{g}.{s}", f"{s}_{g}", f"{g[0]}{s}", f"{g}.{s}+post", f"{s}.{g}+{self._stem(1)}", f"{g}-{s}", f"{g[0]}.{s[0]}", f"{g[0]}.{s}", g, f"info{self.digits(2)}"]).lower()
            host = self._stem(2) + r.choice([".com", ".org", ".in", ".net", ".co.in", ".example", ".test", ".invalid", ".example.com", ".gov.in"])
            e = f"{who}{r.choice(['@', '@', '@', '@', ' @ ', '(at)', '[at]'])}{host}"
            if r.random() < 0.12:  # written out against harvesters
                a, d = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", ".")])
                e = re.sub(r"\s?(?:@|\(at\)|\[at\])\s?", a, e).replace(".", d)
            return [(w, 0) for w in (e.upper() if r.random() < 0.35 else e).split(" ")], EMAIL
        return [(w, 0) for w in self.address().split(" ")], ADDRESS

    def thing(self) -> list[tuple[str, int]]:
        r = self.r
        word = lambda: (self.surname() if r.random() < 0.15 else self.given() if r.random() < 0.1 else ((self._stem(2) + r.choice(["", "a", "en", "or"])).title(), 0))
        return [word(), word()]

    def encounter(self) -> str:
        """A person as subject, as object or after a preposition of an ordinary sentence."""
        r = self.r
        who, verb, what = r.choice(_SUBJECTS), r.choice(_VERBS), r.choice(_OBJECTS)
        said = r.choice([f"{{n}} {verb} {what}", f"{{n}} {r.choice(['had', 'has', 'was', 'is', 'never', 'then', 'also', 'himself', 'who', 'did not', 'may have', 'and {n2}'])} {verb} {what}", f"{who} {r.choice(_MEETS)} {{n}}", f"{who} {verb} {what} {r.choice(_WITH)} {{n}}", f"{what} {r.choice(_WITH)} {{n}} was {verb.split(' ')[0]}", f"{{n}} was {r.choice(_MEETS)} {r.choice(['by', 'with'])} {who}"]).replace("{n2}", "{n}")
        tail = " " + r.choice(_TAILS) if r.random() < 0.6 else ""
        lead = r.choice(_LEADS) + " " if r.random() < 0.5 else ""
        said = lead + said + tail
        return said[0].upper() + said[1:] + r.choice([".", ".", ".", ",", ""])

    def coded(self) -> str:
        """A number, a mail address or a street address in an ordinary sentence."""
        r = self.r
        k = r.choice("teeia")
        who, verb, what = r.choice(_SUBJECTS), r.choice(_VERBS), r.choice(_OBJECTS)
        by = r.choice({"t": "on|from|at|via|through|to|of|by calling|number", "e": "from|to|at|via|by|through|of|with|using", "i": "with|under|of|was|number|against|as|using|bearing the number|bearing", "a": "at|from|to|in|of|near|towards|behind"}[k].split("|"))
        said = r.choice([f"{who} {verb} {what} {by} {{{k}}}", f"{what} {by} {{{k}}} was {verb.split(' ')[0]}", f"{who} could {r.choice(['be', 'only be', 'not be'])} {r.choice(['found', 'traced', 'called', 'seen', 'proved', 'contacted'])} {by} {{{k}}}"])
        said += (r.choice([" ", ", "]) + r.choice(_TAILS) if r.random() < 0.6 else "") + r.choice([".", ".", ".", ",", ""])
        return said[0].upper() + said[1:]

    def sentence(self, entity: dict) -> str:
        r, x = self.r, self.r.random()
        if x < 0.42:
            say = f"{r.choice(_SUBJECTS)} {r.choice(_VERBS)} {r.choice(_OBJECTS)} {r.choice(_TAILS)}"
            if r.random() < 0.3:
                say += f" {r.choice(['and', 'but', 'because', 'so that', 'whereas'])} {r.choice(_SUBJECTS)} {r.choice(_VERBS)} {r.choice(_OBJECTS)} {r.choice(_TAILS)}"
            lead = r.choice(_LEADS) + " " if r.random() < 0.5 else ""
            say = (lead + say) if lead else say[0].upper() + say[1:]
            return (f"{r.randint(1, 90)}. " if r.random() < 0.1 else "") + say + r.choice([".", ".", ".", ",", ""])
        if x < 0.6:
            return r.choice(NONE)
        if x < 0.72:
            return self.encounter()
        if x < 0.82:
            return self.coded()
        return r.choice(r.choices([PERSONS, PLACES_OF, PHONES, MAILS, NUMBERS, THINGS, EITHER], [6, 8, 7, 7, 7, 4, 5 if "q" in entity else 0])[0])

    def document(self) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(text, labelled spans, list bits of words)."""
        r = self.r
        self.text, self.spans, self.bits = "", [], []
        if r.random() < 0.33:
            self._put(r.choice(PARTIES), {"capitals": 0.35})
            return self.text, self.spans, self.bits
        entity: dict = {}
        lines = [None] * r.randint(2, 6)
        if r.random() < 0.5:  # an entity that comes again
            who = (self.person(), NAME) if r.random() < 0.7 else (self.thing(), O)
            entity = {"q": who, "n" if who[1] else "x": who}
            lines += [r.choice([r.choice(PERSONS), self.encounter()]) if who[1] else r.choice(THINGS), *r.choices(EITHER, k=r.randint(1, 2))]
            r.shuffle(lines)
        for line in lines:
            start = len(self.text)
            self._put(line or self.sentence(entity), entity)
            if self.text[-1:] == "," or r.random() < 0.75 and "\n" not in self.text[start:]:
                self.text += " "
            else:
                self.text += "\n"
        return self.text, self.spans, self.bits

    def _put(self, pattern: str, entity: dict) -> None:
        parts = re.split(r"\{(\w+)\}", pattern)
        for k, part in enumerate(parts):
            if k % 2 and part == "n" and "{h}" not in pattern and self.r.random() < 0.12:  # an honorific is no part of the name
                self.text += self.slot("h", {})[0][0][0] + " "
            words, label = self.slot(part, entity) if k % 2 else ([(w, 0) for w in part.split(" ")], O)
            start = len(self.text)
            for j, (w, bits) in enumerate(words):
                if j:
                    self.text += "\n" if self.r.random() < 0.04 else " "
                a = len(self.text)
                self.text += self._spelled(w) if part == "q" and self.r.random() < 0.3 else self._noise(w)
                if bits:
                    self.bits.append((a, len(self.text), bits))
                elif w[:1].isupper() and self.r.random() < 0.03:
                    self.bits.append((a, len(self.text), self.r.choice([1, 2])))
            if label:
                self.spans.append((start, len(self.text), label))

    def _spelled(self, w: str) -> str:
        """Another spelling of a name: a letter doubled, or a vowel or a misread letter changed."""
        r = self.r
        k = r.randrange(1, len(w)) if len(w) > 3 else 0
        if not k:
            return w
        new = r.choice("aeiou") if w[k] in "aeiou" else r.choice([w[k] * 2, _MISREAD.get(w[k], w[k] * 2)])
        return w[:k] + (new.upper() if w.isupper() else new) + w[k + 1 :]

    def _noise(self, w: str) -> str:
        r = self.r
        if len(w) > 5 and w.isalpha():
            x = r.random()
            if x < 0.02:
                k = r.randint(2, len(w) - 3)
                return w[:k] + "-\n" + w[k:].lower()
            if x < 0.04:
                at = [k for k, c in enumerate(w) if k and c in _MISREAD]
                if at:
                    k = r.choice(at)
                    return w[:k] + _MISREAD[w[k]] + w[k + 1 :]
        return w
