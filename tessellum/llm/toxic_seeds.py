"""Seed sentences for the content network, composed from frames and word lists of general knowledge.

No frame is taken from a data set. They only start the training: what the labelled documents hold is learnt from them.
"""

from __future__ import annotations

import random

#: Word lists that fill the slots of the frames, per language.
SLOTS: dict[str, dict[str, tuple[str, ...]]] = {
    "en": {
        "insult": tuple("idiot moron imbecile fool clown loser jerk bastard asshole scumbag coward liar pig bitch creep dope dimwit simpleton disgrace".split()),
        "bad": tuple("stupid dumb worthless pathetic useless miserable disgusting ugly ignorant lazy filthy fucking damn brainless clueless".split()),
        "harm": ("beat", "hurt", "punch", "strangle", "stab", "kick", "slap", "crush"),
        "name": ("Peter", "Maria", "Kevin", "Laura", "Ahmed", "Susan", "Igor", "Mei"),
        "thing": ("parser", "printer", "laptop", "script", "server", "compiler", "meeting room", "config", "test suite", "router"),
        "group": ("immigrants", "foreigners", "refugees", "Muslims", "Jews", "Christians", "Hindus", "Africans", "Asians", "Arabs", "Mexicans", "gypsies", "women", "black people", "people of that faith", "the newcomers", "the tribes of the north", "that nation"),
        "vermin": ("vermin", "animals", "parasites", "rats", "criminals", "thieves", "savages", "dirt", "a disease", "scum", "garbage"),
        "body": ("breasts", "thighs", "nipples", "penis", "pussy", "cock", "ass", "naked body", "tits", "crotch"),
        "lust": ("moaned", "groaned with pleasure", "begged for more", "climaxed", "shivered with lust", "screamed in ecstasy"),
        "who": ("girls", "women", "men", "couples", "models", "teachers", "lovers"),
    },
    "de": {
        "insult": ("Idiot", "Trottel", "Arschloch", "Depp", "Versager", "Schwachkopf", "Dreckskerl", "Schlampe", "Wichser"),
        "bad": ("dumm", "blöd", "erbärmlich", "nutzlos", "widerlich", "hirnlos"),
        "group": ("Ausländer", "Flüchtlinge", "Juden", "Muslime", "Zigeuner", "Schwarzen", "Frauen"),
        "vermin": ("Ungeziefer", "Tiere", "Parasiten", "Verbrecher", "Abschaum", "Ratten"),
    },
    "fr": {
        "insult": ("idiot", "imbécile", "connard", "abruti", "crétin", "salaud", "minable"),
        "bad": ("stupide", "nul", "pathétique", "inutile", "débile", "répugnant"),
        "group": ("étrangers", "immigrés", "réfugiés", "juifs", "musulmans", "arabes", "noirs"),
        "vermin": ("parasites", "animaux", "criminels", "rats", "voleurs", "déchets"),
    },
    "es": {
        "insult": ("idiota", "imbécil", "estúpido", "cabrón", "inútil", "payaso", "cerdo"),
        "bad": ("estúpido", "patético", "inútil", "asqueroso", "ridículo", "miserable"),
        "group": ("extranjeros", "inmigrantes", "refugiados", "judíos", "musulmanes", "gitanos", "negros"),
        "vermin": ("parásitos", "animales", "criminales", "ratas", "ladrones", "basura"),
    },
}
#: Frames of each category and of what is no case (swearing at things, neutral, medical, technical and quoting use).
FRAMES: dict[str, dict[str, tuple[str, ...]]] = {
    "abusive": {
        "en": (
            "You are such a {bad} {insult}!", "You {bad} {insult}.", "{name} is nothing more than a {bad} {insult}.", "Only a {insult} like you could come up with that.", "How can anyone be as {bad} as {name}?", "Shut your mouth, {insult}.", "Hey {insult}, get out of here.", "Piss off, {name}, you {insult}.", "Fuck you and everything you do.",
            "Everybody hates you, {name}.", "Your whole family must be {bad}.", "You make me sick, you {bad} piece of shit.", "I am going to {harm} you when you leave the office.", "Next week I will come over and {harm} you, {name}.", "Somebody ought to {harm} you, {insult}.", "{name} deserves to get hurt badly.", "Be afraid, {name}, I have your address.", "You should be dead by now, {insult}.", "Drop dead, {name}.", "The people who wrote this are {bad} {insult}s.", "You are too {bad} to hold a pencil.", "Stop wasting our time with your {bad} questions, {insult}.",
            "Are you retarded or just {bad}?", "What an utter {insult} you have to be.", "Listen to this {insult} whining again.", "{name} has the brain of a {insult}.", "We all laugh about how {bad} you look.", "If I see you I will {harm} you until you cry.",
        ),
        "de": ("Du bist ein {bad}er {insult}.", "Halt dein Maul, du {insult}.", "Was bist du nur für ein {insult}?", "Hau ab, {insult}, keiner braucht dich.", "Ich schlag dir die Zähne ein, du {insult}.", "Du bist zu {bad} für alles.", "Leck mich am Arsch, {insult}.", "So {bad} wie du ist sonst keiner."),
        "fr": ("Tu es vraiment un {insult}.", "Ferme-la, {insult}.", "Espèce de {insult} {bad}.", "Casse-toi, {insult}, tout le monde te déteste.", "Je vais te frapper, {insult}.", "Tu es trop {bad} pour ce travail.", "Va te faire voir, {insult}.", "Quel {insult}, celui-là."),
        "es": ("Eres un {insult} {bad}.", "Cierra la boca, {insult}.", "Qué {insult} eres.", "Lárgate, {insult}, todos te odian.", "Te voy a pegar, {insult}.", "Eres demasiado {bad} para esto.", "Vete al infierno, {insult}.", "Maldito {insult}, no vales nada."),
    },
    "hateful": {
        "en": (
            "{group} are {vermin}.", "All these {group} are nothing but {vermin}.", "Throw the {group} out of our country.", "We must get rid of {group}, they are {vermin}.", "{group} ruin every neighbourhood they move into.", "No decent person would let {group} into the house.", "{group} are lazy and stupid by birth.", "I despise {group}, the lot of them.", "Our people are worth more than {group}.", "The country would be clean without {group}.", "Never hire or marry any of the {group}.", "{group} behave like {vermin} and deserve to be treated that way.",
            "They should ban {group} from our schools, filthy {vermin}.", "{group} have no right to live here.", "Somebody should burn the {group} out of their homes.", "You cannot reason with {group}, their blood is bad.", "Death to the {group}.", "{group} are a lower race.", "Every one of the {group} is a liar and a thief.",
        ),
        "de": ("{group} sind {vermin}.", "Alle {group} gehören abgeschoben, dieses Pack.", "{group} sind dreckig und faul.", "Wir müssen unser Land von den {group} säubern.", "Niemand will {group} hier haben, sie sind {vermin}.", "Tod den {group}."),
        "fr": ("Les {group} sont des {vermin}.", "Il faut expulser tous les {group}, ce sont des {vermin}.", "Les {group} sont sales et paresseux.", "Notre pays serait propre sans les {group}.", "Je déteste les {group}, tous.", "Mort aux {group}."),
        "es": ("Los {group} son {vermin}.", "Hay que expulsar a todos los {group}, son {vermin}.", "Los {group} son sucios y vagos.", "Nuestro país estaría limpio sin los {group}.", "Odio a los {group}, a todos.", "Muerte a los {group}."),
    },
    "sexual": {
        "en": (
            "She {lust} while he kissed her {body}.", "He {lust} when she touched his {body}.", "His hands were all over her {body} as they fucked.", "She took off her bra and showed him her {body}.", "They had wild sex in the hotel and she {lust}.", "He pushed his {body} into her and she {lust}.", "I want to feel your {body} in my mouth.", "See hot {who} naked on our porn site.", "Sexy {who} strip for you on webcam.", "Free sex chat with naked {who}.", "XXX pictures of {who} having sex.", "Her wet {body} made him hard and he {lust}.", "Come to bed naked, I am horny and want your {body}.", "She rode him slowly and {lust}.", "He licked her {body} until she {lust}.", "Masturbate with nude {who} live tonight.",
        ),
        "de": ("Sie stöhnte, als er ihre nackte Haut küsste.", "Nackte Frauen zeigen ihre Brüste im Pornofilm.", "Er fickte sie die ganze Nacht.", "Ich will Sex mit dir, zieh dich aus.", "Seine Zunge spielte an ihren Nippeln."),
        "fr": ("Elle gémissait pendant qu'il caressait ses seins nus.", "Des femmes nues montrent leurs seins dans ce film porno.", "Il la baisa toute la nuit.", "Je veux coucher avec toi, déshabille-toi.", "Sa langue jouait avec ses tétons."),
        "es": ("Ella gemía mientras él acariciaba sus pechos desnudos.", "Mujeres desnudas enseñan las tetas en esta película porno.", "Él la folló toda la noche.", "Quiero tener sexo contigo, desnúdate.", "Su lengua jugaba con sus pezones."),
    },
    "none": {
        "en": (
            "This {bad} {thing} crashed once more.", "What a {bad} {thing}, it never works.", "The damn {thing} is slow again.", "Fuck, the {thing} is down.", "Holy shit, the {thing} is fast now.", "I hate this {thing}.", "It was {bad} of me to forget the {thing}.", "I felt like an {insult} after I unplugged the {thing}.", "The {thing} is a piece of garbage and needs replacing.", "To hell with the {thing}.",
            "The filter looks for words such as {insult} and {bad}.", "A user wrote \"{insult}\" and the post was hidden by the moderators.", "In the quoted letter the author is called a {bad} {insult}.", "Our policy forbids calling colleagues {bad}.", "The lexicon lists {insult} as an insult.", "Reports about hatred against {group} rose last year, the study says.", "The film shows how {group} were called {vermin} at that time.", "Slogans against {group} are illegal there, the court said.", "Many {group} came to the town for work.", "{group} were counted in the census of 1990.", "The course is open to {group} and residents alike.", "The exhibition on {group} opens in June.", "Rights of {group} are covered in the third lecture.",
            "The {vermin} in the cellar were caught by the landlord.", "Kill the job and its children with signal nine.", "The scheduler executes the orphan and aborts the parent.", "The master beats the slave in this race condition.", "The patient felt pain in the breast and both thighs.", "A lump in the breast should be examined by a doctor.", "Condoms protect against sexually transmitted infections.", "The naked eye cannot see the difference.", "Sex is stored as a single letter in the table.", "The clinic treats men with prostate cancer.", "Chicken thighs and breasts are sold by weight.", "The models are trained on nude colours of lipstick.",
            "Thanks {name}, that was a great help.", "{name} asked a hard question and got a kind answer.", "Please be quiet, {name}, the call is being recorded.", "I am going to fix the {thing} when you leave the office.", "Nobody hates the new {thing} as much as {name}.", "You are right, the {thing} is broken.", "{name} kissed her daughter goodbye and went to work.",
        ),
        "de": ("Der {bad}e Drucker ist schon wieder kaputt.", "Scheiße, der Server ist weg.", "Viele {group} arbeiten in der Stadt.", "Die {group} feierten ein Fest.", "Das Wort {insult} steht auf der Sperrliste.", "Der Arzt untersuchte die Brust der Patientin.", "Danke, das war sehr hilfreich."),
        "fr": ("Cette imprimante {bad} est encore en panne.", "Putain, le serveur est tombé.", "Beaucoup de {group} travaillent dans la ville.", "Les {group} ont fêté la nouvelle année.", "Le mot {insult} est dans la liste de blocage.", "Le médecin a examiné le sein de la patiente.", "Merci, c'était très utile."),
        "es": ("Esta impresora {bad} se ha roto otra vez.", "Joder, el servidor no funciona.", "Muchos {group} trabajan en la ciudad.", "Los {group} celebraron una fiesta.", "La palabra {insult} está en la lista de bloqueo.", "El médico examinó el pecho de la paciente.", "Gracias, fue de gran ayuda."),
    },
}


def sentences(rng: random.Random, copies: int = 2) -> list[tuple[str, str]]:
    """(category or ``none``, sentence): each frame filled ``copies`` times."""
    out = []
    for kind, by_language in FRAMES.items():
        for language, frames in by_language.items():
            slots = SLOTS[language]
            for frame in frames:
                for _ in range(copies):
                    text = frame.format(**{k: rng.choice(v) for k, v in slots.items()})
                    out.append((kind, text[:1].upper() + text[1:]))
    rng.shuffle(out)
    return out


def disguise(text: str, rng: random.Random) -> str:
    """Some longer words starred, spaced, dotted, stretched or written with digits, as people hide them from filters."""
    forms = (
        lambda w, k: w[:k] + "*" + w[k + 1 :],
        lambda w, k: w[0] + "*" * (len(w) - 2) + w[-1],
        lambda w, k: " ".join(w),
        lambda w, k: ".".join(w),
        lambda w, k: w.translate(str.maketrans("aeios", "@3105")),
        lambda w, k: w[:k] + w[k] * rng.randint(3, 5) + w[k + 1 :],
    )
    out = []
    for w in text.split(" "):
        core = w.strip(".,!?:;")
        if len(core) >= 3 and core.isalpha() and rng.random() < 0.35:
            w = w.replace(core, rng.choice(forms)(core, rng.randrange(1, len(core))))
        out.append(w)
    return " ".join(out)
