"""Sentences made by rule, with the places of the personal data in them: what the model of pii.py learns from.

The frames, names and words are general ones; none is taken from a test table. Names are half common ones, half built of syllables, so
that the shape of a span and the words around it carry the weight, and not a list.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

# Invented parts of sentences, names and places.
GIVEN = "James Maria Wei Fatima Carlos Anna Mohammed Sofia David Elena Hans Yuki Pierre Chloe Ivan Olga Raj Meera Kwame Zainab Liam Emma Noah Lucas Mateo Camila Javier Helena Olivia Thomas Lukas Greta Stefan Katarzyna Andrei Ioana Ahmed Layla Chen Mei Hiroshi Sakura Tunde Ngozi Thabo Naledi Sven Astrid Paolo Giulia Marco Lucia Jean Claire Antoine Julie Peter Susan Robert Linda Michael Karen Steven Laura Brian Megan".split()
SURNAMES = "Smith Johnson Williams Brown Garcia Miller Davis Martinez Lopez Wilson Anderson Taylor Moore Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Adams Baker Nelson Carter Mitchell Perez Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Murphy Cook Rogers Bell Cooper Bailey Kelly Howard Ward Cox Richardson Watson Brooks Wood Bennett Gray Hughes Price Sanders Patel Khan Singh Kumar Sharma Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Rossi Russo Ferrari Dubois Moreau Laurent Petit Ivanov Petrov Kowalski Nowak Novak Horvat Andersson Johansson Larsen Hansen Nielsen Virtanen Tanaka Suzuki Okafor Adeyemi Mensah Osei O'Brien McCarthy Silva Santos Ferreira Mendoza Castillo Romero".split()
ONSET = "b br c ch d dr f fl g gr h j k kr l m n p r s st t tr v w y z sh th".split()
VOWEL = "a e i o u ai ei ou ee".split()
CODA = "n r l s m nd rt ck st rn ld nn sk th x".split()
TAIL = "son man ton ford ley field wood ham berg stein ski sky ov ova ic vic ez es ini elli sen dottir land well worth more by escu oglu aki mere ng".split()
STREETS = "Maple Oakwood Willow High King's Victoria Queen Green Chestnut Elmwood Birch Hazel Bridge Castle Market Spring Sunset Lakeview Hillside Washington Lincoln Albert Garden_View Old_Court Great_Western St_John's Manor Meadow Pine Walnut Cherry_Tree River North South Upper_Hill".split()
WAYS = "Road Street Lane Avenue Drive Court Close Crescent Way Gardens Grove Terrace Square Hill Mews Park Place Parkway Row Walk Rd St Ln Ave Dr Blvd Boulevard Rd. St. Ave. Blvd.".split()
FRENCH = "de_la_Paix Victor_Hugo du_Temple de_l'Abbaye des_Lilas des_Fleurs Pasteur de_Rivoli du_Bac des_Acacias".split()
SPANISH = "Mayor Real de_Toledo del_Sol Gran_Victoria de_la_Luna San_Juan Colón".split()
GERMAN = "Haupt Bahnhof Goethe Rosen Linden Wiesen Schiller Wald Mühlen Kastanien Sonnen".split()
TOWNS = "New_York Rio_Grande San_Remo Cape_Town Hong_Kong Leeds Bristol Madrid Springfield Portland Oxford Lyon Hamburg Cork Salem Fairview Little_Marsh New_Haven Kings_Norton Upper_Dale".split()
DOMAINS = "gmail outlook yahoo mycompany webpost protonbox school-mail city hotmail example firm blue-net".split()
TLDS = "com org net co.uk de fr io info edu example test ie com.au co".split()
NOUNS = "order parcel phone laptop battery screen bag jacket coffee cake table chair window door bus train ticket hotel room service delivery app account password printer office project report salary shift break team training course teacher lesson doctor nurse visit queue price menu kitchen garden bottle box shirt shoe lamp radio keyboard cable filter bucket towel carpet fridge oven sofa pillow bike helmet market shop store colour smell taste sound quality size weight contract bill refund support email message answer question survey manager neighbour supervisor colleague product brand item package label cover wheel engine brush soap cream sauce bread butter cheese".split()
VERBS = "broke arrived worked failed helped changed opened closed bought sold used cleaned washed moved kept lost found liked loved hated wanted needed tried returned shipped delivered explained answered ignored fixed replaced painted cooked tasted smelled felt looked seemed became stayed stopped started finished improved reduced increased ordered cancelled compared checked tested carried pushed pulled lifted dropped praised blamed trusted doubted noticed missed expected recommended".split()
ADVERBS = "quickly slowly badly nicely barely hardly really always never often sometimes rarely usually mostly nearly almost suddenly finally eventually clearly strangely politely rudely carefully carelessly happily sadly loudly quietly firmly gently honestly fully partly daily weekly again twice once yesterday today later".split()
ADJECTIVES = "good bad new old big small long short heavy light cheap expensive broken clean dirty fresh stale warm cold soft hard loud quiet fast slow bright dark pretty ugly strong weak thick thin sweet bitter salty sour friendly rude helpful useless useful awful lovely terrible wonderful strange normal simple difficult easy early late empty full sharp dull rough smooth solid loose tight modern generous careful careless patient public private typical".split()
ROLES = "manager supervisor colleague neighbour doctor nurse teacher boss technician driver waiter landlord receptionist dentist trainer assistant agent consultant engineer cashier friend cousin brother sister director lawyer therapist plumber courier husband wife partner mother father son daughter tutor coach chef".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Mr. Mrs. Ms. Dr. Prof.".split()
SAYS = "said told_me helped_me called replied explained_it wrote_back answered was_kind was_rude was_great never_came handled_it handled_the_complaint handled_my_order fixed_it promised_a_refund served_us came_late did_a_great_job took_my_call knows_more sorted_it_out refused_to_listen has_a_copy lives_next_door".split()
DEPARTMENTS = "sales support accounting marketing finance logistics reception billing management payroll it hr".split()
DIGITS = "zero oh one two three four five six seven eight nine".split()

#: Given names that are words of everyday language as well.
WORDLIKE = "mark will may rose grace hope faith pat rob frank bill joy art sunny june april dawn robin jack drew sue chase grant miles dean penny ray".split()
#: Words of everyday language: a span made of them is rarely a name.
ORDINARY = frozenset(f"{' '.join(NOUNS + VERBS + ADVERBS + ADJECTIVES + ROLES + DEPARTMENTS)} food water wrong right day night week time hour visit team desk style scent wood stone line branch centre part box gift set kit pack page press maps year people someone nobody everyone others needs need compared included because although yet than per euro pound street road lane avenue drive park hill square way row truth front side end start first second third last next old food music city town village country habit case fact luck".split())

NAME_FRAMES = (
    "I {v} {} {r}.", "We {v} {} at the {n}.", "They {v} {} {r}.", "{} {v} the {n}.", "{} {v} {r} for the {n}.", "The {n}, {}, {v} it.", "The {n} {v} {} twice.", "to {v} {} on the {n}", "because {} {v} the {n}", "so {} {v} us", "The {role} {} {v} {n} over me.", "the {a} {} {v} it",
    "I must praise {} for the {n}.", "{} and the {role} {v} it.", "Both {} and the {role} {v}.", "{} picked the {n} up.", "I asked {} {r}.", "Last week {} {v} our {n}.", "My {role} {} {v} it.", "When {} left, the {n} {v}.", "the {n} of {}", "we saw {} at the {n}", "They gave {} my {n}.", "{}, a {role}, {v} the {n}.", "{} signed for the {n}.", "{} has been {a} to us.",
    "Contact {} if there is a problem.", "Please contact {}.", "The {role}, {}, {say}.", "My {role} is {}.", "My {role} {} {say}.", "Our {role} {} {say}.", "the {role} ({}) {say}", "{title} {} {say}.", "{title} {} {say}.", "I saw {title} {} about it.", "{} {say}.", "{} {say}.", "I met {} at the {n}.",
    "We were looked after by {}.", "I dealt with {} and it was {a}.", "I spoke to {} about the {n}.", "Thank you, {}!", "Thanks to {} the {n} {v}.", "Many thanks to {} for the {a} {n}.", "A big thank you to {}, who {v} it.", "Ask {} about it.", "You should ask for {}.", "Just ask for {}, the {role}.",
    "Best, {}", "Best wishes, {}", "Yours, {}", "Regards, {}", "Kind regards {}", "Signed {}", "Sincerely, {}", "Cheers, {}", "- {}", "Dear {}, the {n} {v}.", "Hello {}, my {n} {v}.", "Hi {}", "My name is {}.", "my name is {} and my {n} {v}", "I am {} and I am {a}.", "This is {} writing.", "Name: {}", "Customer: {}", "cc: {}", "Attn: {}",
    "{} from {dep} {say}.", "{} from {dep} {say}", "{} in {dep} {say}.", "According to {} it is {a}.", "A {role} called {} {say}.", "a {role} named {} {v} it", "I was told by {} to wait.", "It was {} who {v} my {n}.", "{} and I {v} the {n}.", "They sent {} to fix the {n}.", "I gave the {n} to {}.", "Call {} at the {n}.", "Reach out to {} for help.", "He said {} would call back.", "I talked with {} {r}.", "I have met {} {r}.", "the call with {} was {a}",
)
EMAIL_FRAMES = ("Email me at {}.", "Send it to {}", "my address is {}", "Mail: {}", "contact {} please", "Write to {} for the receipt.", "{}", "({})", "<mailto:{}>", "reply to <mailto:{}>", "I can be reached at {}, thanks.", "E-mail={}", "you can find me at {}", "Use {} for the refund.", "My work mail, {}, is full.")
PHONE_FRAMES = ("Phone me on {}.", "Tel: {}", "call {} after six", "my mobile is {}", "You can text {}.", "My phone number is {}, thanks.", "fax: {}", "cell {}", "Ring me at {} tomorrow.", "They can reach me on {}.", "whatsapp: {}", "number {} rings all day", "phone {}", "Contact: {}")
ADDRESS_FRAMES = ("I live at {}.", "My address is {}.", "address: {}", "Deliver to {} please.", "It was sent to {} by mistake.", "We are at {} now.", "Please ship to {}.", "The parcel for {} got lost.", "{} is where I live.", "It is at {}, behind the {n}.", "Left at {}, by the {n}.", "My house, {}, was skipped.", "Come to {} for the {n}.", "Our flat at {} is {a}.", "I moved from {} last year.")
TRAPS = (
    "The {n} was {a} and the {n} {v} {r}.", "My {role} {v} the {n} {r}.", "The {role} was {a}, but the {n} {v}.", "My {role} said it was {a}.", "Our {role} felt {a} and the {n} {v}.", "The {a} {role} {r} {v} every {n}.", "A {role} {v} it {r}.", "{Role}: {a} {n} {v} {r}", "{role}={a} {n} {v}", "{Role} - {a} {n} and {n}", "* {Role}: {n} {v}; {Role}: {a} {n}", "without any {role} the {n} {v}", "the {role} {v} me and my {n}", "It seems the {role} or the {a} {n} {v} us.", "as {a} as this {role} {v} the {n}",
    "I spoke with a {a} {role} {r}.", "I asked for a {a} {n}.", "thanks to a {a} {n}", "My name is on the {n}.", "The {n} {v} {r}.", "It {v} because the {n} was {a}.", "Regards for the {n} are {a}.", "Best {n} of the year.", "Hope this helps.", "Dear team, the {n} is {a}.", "Hello, my {n} {v}.", "Call the {n} {r}.", "Contact was {a}.", "They handled the {n} {r}.", "It was handled {r}.", "The {n} from {dep} {v}.", "nobody from {dep} called", "someone in {dep} {v} it", "The man from {dep} was {a}.",
    "The {B} is {a}.", "Our {B} {v} {r}.", "I bought a {B} {d3} for my {n}.", "The {B} {d2} {n} was {a}.", "Bought the {B} {r}.", "Loved the {B}.", "my new {B}, the {a} one", "{B} {d3} {v} the {n}.", "Nothing beats {B}.", "the {n} from {B} was {a}", "My {role} from {B} {v} it.", "Will buy from the {B} shop.", "Compared with {B} {d2} it is {a}.", "The {B} {n} and the {B} {n} {v}.", "They opened a {B} branch.", "The {St} branch {v}.", "The {St} {Way2} bus was {a}.", "The {St} line is {a}.", "The bill from {B} came {r}.",
    "The {n}-{g} {v} {r}.", "my {n}-{g} {r}", "a {a} {g}", "The {g}, yet the {n} {v}.", "every {g} because the {n} {v}", "the {a} {n} {g} and the {n}", "{G} {r} {v} the {n}.", "{G} {Nn} is a {a} {n}.", "The {Aa} {Nn} {v}.", "{Nn}, {Nn} and {Nn}", "we {v} the {g} although it was {a}", "out of {g} {n}", "{Aa} {Nn} {Vv} {r}", "some {g} {v} the {n}",
    "{d1} left @ {d1}.{d2} each", "Bought @ {d2}.{d2} each at {B}.", "{n}, {n}, {n}-{g}, {B}", "the {n}-{g} {n} was {a}", "as {a} {n} {g} goes", "the {a} {role} {a} {n}", "{a} {n}, {a} {role}, {a} {n}", "{Nn} {d3} {r} {v} my {n}.", "{B} {d3} {r} {v} my walk.", "Grace Period ended after {d2} days.", "{G} {Nn} ended {r}.",
    "{Tw} style {n} {v}.", "Street Food from the {n} was {a}.", "Fast Food {v}.", "next to Street Food on floor {d1}", "the Home Office {v}", "the Help Desk and the Front Desk {v}", "the {Tw} office {v} {r}", "I live in {Tw}.", "They moved to {Tw} {r}.", "the {Tw} team and the {n}", "at the {Tw} branch the {n} {v}", "A {Tw} {n} costs more.", "The {role} {r} {v} the {n}.", "my {role} {v} us within an hour", "the {a} and {a} {role} across town {v}", "our {role} between two {n}s {v}", "{Role}: {a} {n} {r} {v}", "{Role} - {a} {n} {r} {v}", "{role}={a} {n} {r} {v}; {role}={a} {n} {v}", "the {n} or the {role} {r} {v} us", "a {role} {r} {v} my {n} because its {n} was {a}", "no {role} {v} {r} before noon", "{Role} {a} {n} {v}", "the {role} although {a} {v}",
    "Saw it on {D} with a {n}.", "In {Mo} the {n} {v}.", "{Mo} and {D} were {a}.", "May I return the {n}?", "Will the {n} last?", "Mark the {n} as {a}.", "Rose {n} and {a} {n}.", "Sunny {n}, {a} {n}.", "Grace and {n} matter.", "Bill me {r}.", "Frank words about the {n}.", "Hope and {a} {n}.", "Pat the {n} dry.", "Art and {n} are {a}.", "Rob the {n} of its {n}.", "Joy of a {a} {n}.", "Faith in the {n} is {a}.", "I will {r} pat the {n}.", "may the {n} be {a}", "Happy Birthday cake was {a}.", "The New York style {n} is {a}.", "French Press coffee {v}.", "Italian {n} is {a}.", "Google Maps {v}.", "the Customer Service desk {v}", "The Sales Team {v}.",
    "Order {d5}-{d1} came on {d2}-{d2}-{d4}.", "Order {d4} {d4} {d2} is late.", "Invoice {d5}{d3} is wrong.", "Invoice no. {d4} {d4} is wrong.", "ticket #{U}-{d5} is open", "Ticket {d5}{d2} is open.", "SKU {d5}-{d3} is {a}.", "Serial {U}{U}{d5}{d3} is on the {n}.", "Part no. {d4}-{d3} is missing.", "tracking {d5}{d5} is {a}", "model {U}{U}-{d4} is {a}", "code {U}{d4}{U}{d2} did not work", "voucher {d4}-{d4}-{d2}", "Version {d1}.{d1}.{d2} {v}.", "Batch {d4}.{d2}.{d2} was {a}.", "barcode {d5}{d5}{d3}", "It cost ${d1},{d3}.00.", "{d1},{d3},{d3} points a year", "{d2} 000 000 points", "page {d3} of {d3}", "The code is on page {d3}.", "ISO {d4} is printed on it.", "from {d4} to {d4}", "{d3} x {d3} x {d2} cm", "{d2}:{d2}:{d2} {d2}/{d2}/{d4}", "{d2}.{d2}.{d4}", "open 24/7", "{d4}-{d4} season", "Room {d2} on floor {d1}, {d2}-{d2} people", "catalogue {d3}-{d4}, page {d2}", "lane {d1} was closed", "row {d2} lane {d1}", "{d2} square meals", "box {d1} of {d2}", "The box {d2} was {a}.", "aisle {d1} Street Food", "{d2} {a} {n} drive sales", "{d1} star avenue style {n}", "{d2} way {n}", "{d3} park visitors",
    "my passport cover is {a}", "The tax went up by {d2}.{d1} percent.", "A driving licence holder {v}.", "The ID badge was {a}.", "ID tag {d4}-{U} hung on the {n}.", "my card was refused", "at {d1} o'clock @ the {n}", "{d2} @ {d1}.99 each", "five stars and one dot at the end", "one at a time", "two or three times, maybe four", "[{d2}:{d2}:{d2}] ERR{d4} 0x{h} {n}={d4}", "E{d4} 0x{h}", "0x{h} 0x{h}", "{h}{h}", "a,b,{d1},{d2}.{d2},{n}", "{n} | {d2} | {d2}.{d2} | {a}", "{n}\t{d2}\t{d2}.{d2}", "{d5} {d4} {d5}{d2} {d3}", "{d3} {d5}{d2} {d4} {d5}{d1}", "{d4} {d4} {d5}{d3} {d5} {d2}", "{d4}{d3} {d5} {d5}{d1}", "{d4} {d3} {d5}{d3} {d5} {d5}{d1} {d2} {d3}", "{d5}{d2} {d3}{d3} {d5}",
)
#: Rows of numbers that are no personal data, and frames of numbers of many chunks that are.
RUNS = (
    "values {d1} {d1} {d1} {d1} {d1} {d1} {d1} {d2}", "{d2} {d2} {d2} {d2} {d2} {d2}", "[{d2}:{d2}:{d2}] {d1} {d2} {d3} {d2} {d2} {d2} {d2}", "We scored {d1} {d1} {d1} {d1} {d1} {d1} in the {n}.", "{d1} {d1} {d1} {d1} {d1} {d1} {d1} {d1} {d1}",
    "Rows {d2} {d2} {d2} {d2} {d2} {d2} {d2} of the {n}.", "{B} {d1} {d2} {d1} {d2} {d1} {d2} {d3}", "lottery {d1} {d1} {d2} {d2} {d2} {d2}", "{n} {d1} {d2} {d2} {d2} {d2} {d2}",
)
LONG_IDS = ("My social security number is {}.", "social security {}", "they have {} as my social security number", "insurance number: {}")


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _upper(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))


def _case(rng: random.Random, s: str) -> str:
    x = rng.random()
    return s.upper() if x < 0.1 else s.lower() if x < 0.24 else s.title() if x < 0.3 else s


def _syllables(rng: random.Random) -> str:
    return (rng.choice(ONSET) + rng.choice(VOWEL) + rng.choice(CODA)).capitalize()


def _surname(rng: random.Random) -> str:
    x = rng.random()
    if x < 0.4:
        return rng.choice(SURNAMES)
    return _syllables(rng) + (rng.choice(TAIL) if x < 0.9 else "")


def _name(rng: random.Random, known: list[str]) -> str:
    x = rng.random()
    first = f"{rng.choice(GIVEN)}-{rng.choice(GIVEN).lower() if rng.random() < 0.5 else rng.choice(GIVEN)}" if x < 0.03 else rng.choice(GIVEN) if x < 0.35 or not known else rng.choice(known).capitalize() if x < 0.75 else _syllables(rng) + rng.choice("aeiou")
    last = _surname(rng)
    return _case(rng, rng.choice((f"{first} {last}",) * 6 + (f"{last}, {first}", f"{first[0]}. {last}", f"{first} {rng.choice('ABCDEFKLMR')}. {last}", first, last)))


def _email(rng: random.Random, known: list[str]) -> str:
    first, last = rng.choice(GIVEN + [k.capitalize() for k in known[:30]]), _surname(rng).replace("'", "")
    local = rng.choice((f"{first}.{last}", f"{first}_{last}", f"{first}-{last}", f"{first}{last}", f"{first[0]}{last}", f"info{_digits(rng, 2)}", f"{first}{_digits(rng, 2)}+news", f"shop{_digits(rng, 2)}+survey", f"hello{_digits(rng, 3)}")).lower()
    address = f"{local}@{rng.choice(DOMAINS)}.{rng.choice(TLDS)}"
    how = rng.random()
    if how < 0.14:
        address = address.replace("@", " (at) ").replace(".", " (dot) ")
    elif how < 0.28:
        address = address.replace("@", " at ").replace(".", " dot ")
    elif how < 0.36:
        address = address.replace("@", "[at]")
    elif how < 0.42:
        address = address.replace("@", " @ ")
    elif how < 0.5:
        address = address.upper()
    return address


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    country = rng.choice(("44", "49", "33", "34", "39", "61", "91", "353"))
    k = rng.randrange(18)
    return (f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"{b}-{c}", f"+{country} 7{a} {b} {c[:3]}", f"07{a} {b}{c[:3]}", f"020 {c} {_digits(rng, 4)}", f"+49 (0){rng.choice(('30', '40', '89', '221'))} {_digits(rng, 5)} {b}",
            f"00{country} 7{a}{b}{c[:3]}", " ".join(rng.choice(DIGITS) for _ in range(rng.choice((7, 7, 10)))), f"{a}-{b}-{c}", f"+33 {a[0]} {b[:2]} {c[:2]} {c[2:]} {a[1:]}", f"0{a} {b} {c}", f"0{a[:2]}/{b}{c}", f"0{a}{c[0]} {b} {c[1:]}", f"+{country}{a}{b}{c}")[k]


def _id(rng: random.Random) -> tuple[str, tuple[str, ...]]:
    d, up = (lambda n: _digits(rng, n)), (lambda n: _upper(rng, n))
    k = rng.randrange(6)
    loose = ("{} is mine.", "{}, as the clerk wrote.", "They have {} on my file.", "I gave them {} twice.", "{} is how they find me.")
    if k == 0:
        return rng.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}")), ("My SSN is {}.", "SSN: {}", "social security number {} was asked for", "They wanted my social security number, {}, by mail.", "my social is {}", "{} is my social security number", "{} was on the form as me.", *loose)
    if k == 1:
        return rng.choice((f"{up(2)} {d(2)} {d(2)} {d(2)} {rng.choice('ABCD')}", f"{up(2)}{d(6)}{rng.choice('ABCD')}")), ("National insurance number: {}", "NI number {}", "my national insurance is {}", "NINO {}", "{} was typed in wrongly.", "They kept {} on record.", *loose)
    if k == 2:
        return rng.choice((f"{up(2)}{d(7)}", f"{up(1)}{d(8)}", f"{up(2)} {d(7)}", f"{up(1)}{d(2)}{up(1)}{d(2)}{up(1)}{d(2)}", d(9))), ("Passport number {}", "my passport {} ran out", "passport: {}", "The passport, {}, got lost.", "passport no {}", "Passport no. {}", "my passport, no. {}")
    if k == 3:
        return rng.choice((f"{d(8)}-{up(1)}", f"{d(8)}{up(1)}", f"{up(1)}{d(2)}{up(1)}{d(5)}", f"{up(2)}{d(6)}")), ("ID card {}", "identity card number: {}", "my national ID is {}", "I showed my ID card ({}) twice.", "I showed my card, {}, at the door.", "identity number {}", "ID no. {}")
    if k == 4:
        return rng.choice((f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(3)}/{d(3)}/{d(4)}")), ("Tax ID {}", "tax number: {}", "Tax no. {}", "tax id: {}", "my tax reference is {}", "the tax office knows me as {}", "They copied {} from my tax form.", "{} is my tax number.")
    return rng.choice((f"{up(5)}{d(6)}{up(1)}{d(1)}{up(2)}", f"{up(1)}{d(3)}-{d(4)}-{d(4)}", f"{up(1)}{d(7)}")), ("driving licence {}", "Driver's license: {}", "my licence number is {}", "licence {} has expired", "Licence no. {}", "They wrote {} from my licence down.")


def _address(rng: random.Random) -> str:
    n = str(rng.randrange(1, 300)) + rng.choice(("", "", "", "a", "b"))
    street = f"{n} {rng.choice(STREETS).replace('_', ' ')} {rng.choice(WAYS)}"
    town = rng.choice(TOWNS).replace("_", " ")
    k = rng.randrange(10)
    if k < 2:
        s = street
    elif k == 2:
        s = f"{street}, {rng.choice(('Apt', 'Unit', 'Suite', 'Flat', 'Apt.'))} {rng.randrange(1, 60)}"
    elif k == 3:
        s = f"{rng.choice(('Flat', 'Apartment', 'Unit'))} {rng.randrange(1, 60)}, {street}, {town} {_digits(rng, rng.choice((4, 5)))}"
    elif k == 4:
        s = f"{street}, {town} {_upper(rng, 2)}{_digits(rng, 1)} {_digits(rng, 1)}{_upper(rng, 2)}"
    elif k == 5:
        s = f"{n}{rng.choice(('', ','))} {rng.choice(('rue', 'rue', 'avenue', 'boulevard', 'place'))} {rng.choice(FRENCH).replace('_', ' ')}"
    elif k == 6:
        s = f"{rng.choice(('Calle', 'Avenida', 'Via', 'Rua', 'Plaza'))} {rng.choice(SPANISH).replace('_', ' ')}{rng.choice((',', ''))} {n}" + rng.choice(("", f", {town}"))
    elif k == 7:
        s = f"{rng.choice(GERMAN)}{rng.choice(('straße', 'str.', 'weg', 'allee', 'gasse', 'platz', 'ring'))} {n}"
    elif k == 8:
        s = f"{rng.choice(('P.O. Box', 'PO Box', 'P.O.Box'))} {_digits(rng, rng.choice((3, 4, 5)))}" + rng.choice(("", f", {town}"))
    else:
        s = f"{street}, {town}"
    return _case(rng, s)


def _product(rng: random.Random) -> str:
    """A made-up brand: one or two capitalised words that are no person."""
    word = _syllables(rng) + rng.choice(("", "a", "ix", "o", "ora", "ivo", "exa", "lan", "ium", "ify")) + rng.choice(("", "", _syllables(rng).lower()))
    return word + rng.choice(("", "", "", " " + rng.choice(("Pro", "Plus", "Max", "One", "Home", "Mini"))))


def _value(rng: random.Random, k: str) -> str:
    if k[0] == "d" and k[1:].isdigit():
        return _digits(rng, int(k[1]))
    return {
        "Tw": lambda: rng.choice(TOWNS).replace("_", " "), "h": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(8)), "B": lambda: _product(rng), "U": lambda: _upper(rng, 1), "n": lambda: rng.choice(NOUNS), "a": lambda: rng.choice(ADJECTIVES), "v": lambda: rng.choice(VERBS), "r": lambda: rng.choice(ADVERBS),
        "role": lambda: rng.choice(ROLES), "Role": lambda: rng.choice(ROLES).capitalize(), "title": lambda: rng.choice(TITLES), "say": lambda: rng.choice(SAYS).replace("_", " "), "dep": lambda: rng.choice(DEPARTMENTS), "St": lambda: rng.choice(STREETS).replace("_", " "), "Way2": lambda: rng.choice(("Road", "Street", "Park", "Hill")),
        "g": lambda: rng.choice(WORDLIKE), "G": lambda: rng.choice(WORDLIKE).capitalize(), "Nn": lambda: rng.choice(NOUNS).capitalize(), "Aa": lambda: rng.choice(ADJECTIVES).capitalize(), "Vv": lambda: rng.choice(VERBS).capitalize(),
        "D": lambda: rng.choice(("Monday", "Friday", "Sunday", "Wednesday")), "Mo": lambda: rng.choice(("June", "March", "December", "April")),
    }[k]()


def _fill(rng: random.Random, frame: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: _value(rng, m.group(1)), frame)


def _trap(rng: random.Random, traps: tuple[str, ...] = TRAPS) -> str:
    return _case(rng, _fill(rng, rng.choice(traps)))


def sentences(rng: random.Random, known: list[str], count: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, type)]): one to three sentences, about half of which hold personal data or look as if they did."""
    for _ in range(count):
        parts: list[tuple[str, str | None, str]] = []
        for _ in range(rng.choice((1, 2, 2, 3))):
            if rng.random() < 0.5:
                parts.append((_trap(rng), None, ""))
                continue
            kind = rng.choice(("email", "phone", "id_number", "id_number", "address", "name", "name", "name", "name", "name"))
            if kind == "id_number":
                value, frames = _id(rng)
            else:
                value = {"email": lambda: _email(rng, known), "phone": lambda: _phone(rng), "address": lambda: _address(rng), "name": lambda: _name(rng, known)}[kind]()
                frames = {"email": EMAIL_FRAMES, "phone": PHONE_FRAMES, "address": ADDRESS_FRAMES, "name": NAME_FRAMES}[kind]
            frame = _fill(rng, rng.choice(frames))
            if value.islower() and rng.random() < 0.6:
                frame = frame.lower()
            elif value.isupper() and any(c.isalpha() for c in value) and kind in ("name", "address") and rng.random() < 0.6 or rng.random() < 0.05:
                frame = frame.upper()
            parts.append((frame, value, kind))
        text, gold = "", []
        for frame, value, kind in parts:
            if text:
                text += rng.choice((" ", " ", " ", "\n"))
            if value is None:
                text += frame
                continue
            a, b = frame.split("{}")
            gold.append((len(text) + len(a), len(text) + len(a) + len(value), kind))
            text += a + value + b
        yield text, gold


def runs(rng: random.Random, count: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """As sentences(): rows of many numbers, a third of which are numbers of a person."""
    for _ in range(count):
        if rng.random() < 0.67:
            yield _trap(rng, RUNS), []
            continue
        a, b = rng.choice(LONG_IDS).split("{}")
        value = " ".join(_digits(rng, n) for n in (1, 2, 2, 2, 3, 3, 2))
        yield a + value + b, [(len(a), len(a) + len(value), "id_number")]
