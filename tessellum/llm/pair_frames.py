"""Broken and odd responses for the pair classifier, composed by rule from parts of general knowledge.

Every kind is a list of *families*; a family's members share their wording. Families are split between training and
calibration before anything is made from them, so thresholds are set on wordings that the training has not seen.
``{t}`` takes words of the question, ``{a}`` a whole answer and ``{l}`` one without its capital.
"""

from __future__ import annotations

from itertools import product

#: Fixed value: what the service answers where retrieval found nothing.
FALLBACK = "I cannot answer this based on the available lecture notes."

_PLEAS = ("", "Sorry, ", "I'm sorry, but ", "I am very sorry. ", "Unfortunately, ", "I apologize, but ", "Regrettably, ", "Pardon me, but ", "Oh, ", "Well, ")
_UNABLE = ("I cannot", "I can't", "I'm unable to", "I am unable to", "I am not able to", "I'm not in a position to", "I could not", "it is not possible for me to", "I am not permitted to", "I'm not allowed to")
_UNWILLING = ("I will not", "I won't", "I refuse to", "I decline to", "I have to decline to", "I would rather not", "I'd prefer not to", "I do not want to", "I choose not to", "I must refuse to")
_ACTS = ("answer this", "answer that question", "help with this", "help you here", "respond to this request", "say anything about {t}", "comment on {t}", "assist with {t}", "discuss {t}", "give you an answer", "judge {t}", "provide that", "tell you")
_WHERE = ("the context", "the documents", "the sources", "the given text", "the material", "my notes", "the files I have", "the knowledge base", "the passages")
_CLOSERS = ("", "", "", " Please try another question.", " Is there anything else?", " Can I help with something else?", " You may want to ask a colleague.", " Please rephrase your question.")

#: Refusals: declines, and statements that nothing is known.
REFUSALS: list[list[str]] = [
    [FALLBACK],
    *[[f"{p}{v} {act}.{c}" for p, v, c in zip(_PLEAS, _UNABLE, _CLOSERS * 2, strict=False)] for act in _ACTS],
    *[[f"{p}{v} {act}.{c}" for p, v, c in zip(_PLEAS, _UNWILLING, _CLOSERS * 2, strict=False)] for act in _ACTS],
    *[[f"{w[0].upper()}{w[1:]} {v}.", f"{p}{w} {v}, so {u} {act}."] for w, v, p, u, act in zip(_WHERE * 2, ("does not say", "says nothing about {t}", "contains no answer", "holds no information on {t}", "never mentions {t}", "does not cover {t}", "gives no hint", "lacks any detail on {t}", "is silent about {t}") * 2, _PLEAS[1:] * 2, _UNABLE * 2, _ACTS * 2, strict=False)],
    ["I don't know.", "I do not know.", "I really don't know.", "I don't know the answer.", "I do not know that, sorry."],
    ["No idea.", "I have no idea.", "I have no clue.", "I haven't the faintest idea."],
    ["I am not sure.", "I'm not certain about {t}.", "Hard to say, I am not sure about {t}."],
    ["I have no information about {t}.", "I have no data on that.", "I do not have any information on {t}.", "I don't have the necessary information."],
    ["I found nothing about {t}.", "I could not find {t}.", "Nothing on {t} was found.", "There is nothing about {t} in what I was given.", "My search for {t} gave no results."],
    ["There is not enough information to answer.", "The available information is not sufficient.", "I don't have enough context to answer.", "Too little is known to answer."],
    ["As an AI model, I have no opinion on {t}.", "As an AI assistant, I cannot do that.", "Being a language model, I do not have access to {t}.", "I'm just an AI and cannot know that."],
    ["That goes against my guidelines.", "This violates my instructions.", "My policy does not allow this.", "This topic is off limits for me."],
    ["That is outside my area.", "{t} is beyond my knowledge.", "This lies outside of my scope.", "I was not trained for questions on {t}."],
    ["Please ask someone else.", "You should ask an expert about {t}.", "I suggest to ask the support team.", "Better ask somebody who knows {t}."],
    ["No comment.", "I'd like to skip this one.", "Let us talk about something else.", "I pass."],
    ["I wish I knew.", "I would help if I could, but I know nothing about {t}.", "Much as I would like to help, I know too little about {t}."],
    ["Es tut mir leid, das kann ich nicht beantworten.", "Leider kann ich darauf keine Antwort geben.", "Ich kann dazu nichts sagen.", "Diese Frage kann ich nicht beantworten."],
    ["Das weiß ich nicht.", "Ich weiß es leider nicht.", "Keine Ahnung.", "Darüber weiß ich nichts."],
    ["Dazu habe ich keine Informationen.", "Im Kontext steht nichts über {t}.", "Die Unterlagen sagen dazu nichts.", "Ich habe dazu nichts gefunden.", "Mir fehlen dazu die Angaben."],
    ["Ich möchte dazu nichts sagen.", "Das darf ich nicht beantworten.", "Ich lehne es ab, darauf zu antworten.", "Dabei helfe ich nicht."],
    ["Désolé, je ne peux pas répondre.", "Je suis incapable de répondre à cela.", "Malheureusement, je ne peux pas vous aider.", "Il m'est impossible de répondre."],
    ["Je l'ignore.", "Je n'en sais rien.", "Aucune idée.", "Je ne connais pas la réponse."],
    ["Je n'ai pas d'informations sur {t}.", "Le contexte ne dit rien de {t}.", "Je n'ai rien trouvé sur {t}.", "Les sources ne contiennent pas la réponse."],
    ["Je refuse de répondre.", "Je ne souhaite pas répondre.", "Je ne veux pas parler de {t}."],
    ["Lo siento, no puedo responder.", "Por desgracia no puedo ayudarle.", "Me es imposible contestar.", "No soy capaz de responder a eso."],
    ["No sé.", "No lo sé, lo siento.", "Ni idea.", "Desconozco la respuesta."],
    ["No tengo información sobre {t}.", "El contexto no dice nada de {t}.", "No encontré nada sobre {t}.", "Las fuentes no contienen la respuesta."],
    ["No quiero responder.", "Me niego a contestar.", "Prefiero no hablar de {t}."],
    ["Mi spiace, non lo so.", "Non posso rispondere a questa domanda.", "Non ho informazioni su {t}."],
    ["Desculpe, não sei.", "Não posso responder a essa pergunta.", "Não tenho informações sobre {t}."],
    ["Sorry, dat weet ik niet.", "Ik kan die vraag niet beantwoorden.", "Ik heb geen informatie over {t}."],
    ["No reply is possible from what I have here.", "No statement on {t} can be made.", "No conclusion on {t} can be drawn from the material.", "No explanation can be offered for {t}.", "No verdict can be reached on these texts.", "A reply to this cannot be derived from the passages.", "None of the texts lets me reply."],
    ["No matching results turned up.", "No suitable entries came up for {t}.", "No useful hits were returned.", "The search returned no matches."],
    ["No hay datos sobre {t}.", "No se ha encontrado nada sobre esto.", "Los textos no bastan para contestar."],
    ["Aucune donnée n'est disponible à ce sujet.", "Rien n'a été trouvé pour {t}.", "Les passages ne suffisent pas pour répondre."],
    ["Hierzu liegt mir nichts vor.", "Über {t} liegen keine Daten vor.", "Zu dieser Frage liegen uns keine Auskünfte vor.", "Dafür fehlt mir jede Grundlage."],
]
#: Sound answers that open like a refusal or speak of refusing, or of what cannot be done.
DECOYS: list[list[str]] = [
    ["Sorry for the wait. {a}", "Apologies for the long answer. {a}", "Pardon the delay. {a}"],
    ["I can't recommend it enough: {a}", "I cannot thank you enough for asking. {a}"],
    ["Unfortunately it does: {a}", "Regrettably that is true. {a}", "I regret to say that it is so: {a}"],
    ["No, it can't. {a}", "It cannot do so. {a}", "It is unable to. {a}"],
    ["I do not know a better way than this: {a}", "I know of no other reason. {a}"],
    ["The manual does not mention it, yet {l}", "The notes say nothing of it, but {l}"],
    ["It will not answer before {l}", "The server refuses to answer since {l}", "It declines the call because {l}"],
    ["I'm not certain about the details, but {l}", "As far as I know, {l}", "If I remember well, {l}"],
    ["There is no information lost: {a}", "No data is missing. {a}", "Nothing is wrong. {a}"],
    ["You cannot turn it off. {a}", "One must not skip this. {a}"],
    ["Leider ja. {a}", "Das geht nicht anders: {a}", "Malheureusement oui. {a}", "Por desgracia sí. {a}"],
]
_HOLLOW = ("n/a", "na", "none", "null", "nil", "undefined", "nan", "empty", "blank", "tbd", "todo", "no answer", "no response", "no reply", "no output", "not available", "not applicable", "nothing", "void", "missing", "placeholder", "lorem ipsum")
_HOLLOW_FAR = ("keine", "keine antwort", "leer", "entfällt", "néant", "vide", "sans réponse", "aucune", "vacío", "ninguna", "sin respuesta", "n. v.")
_LABELS = ("answer", "response", "reply", "assistant", "bot", "output", "result", "a")
#: What stands for nothing: white space, marks, placeholder words in several dresses, labels and tags around nothing.
FILLERS: list[list[str]] = [
    ["", " ", "\n", "\t", " \n\n "],
    [m * n for m, n in product("-.?_*", (1, 2, 3))],
    ["…", "—", "{}", "[]", "()", '""', "''", "``", "//", "<>", "|"],
    ["​", "﻿", " "],
    *[[w, w.upper(), w.capitalize(), f"({w})", f"[{w}]", f"<{w}>", f"{w}.", f"**{w}**"] for w in (*_HOLLOW, *_HOLLOW_FAR)],
    *[[f"{x}:", f"{x.capitalize()}:", f"{x.capitalize()}: ", f"<{x}></{x}>", f"<{x}/>", f"[{x}]"] for x in _LABELS],
    ["<br>", "<p></p>", "<div> </div>", "&nbsp;"],
]
_UNITS = ("", "%", " ms", " GB", " seconds", " days", " tokens", " rows", " Minuten", " heures", " veces")
#: Short answers that are complete.
SHORT: list[list[str]] = [
    [f"{n}{u}" for n, u in zip(("3", "17", "250", "0.7", "1,024", "42", "6.5", "90", "12", "8", "5"), _UNITS, strict=True)],
    [f"{p} {n}{u}." for p, n, u in zip(("About", "Around", "At most", "Up to", "Exactly", "Rund", "Environ", "Unos"), (4, 9, 60, 300, 2, 15, 20, 33), _UNITS, strict=False)],
    ["Yes.", "No.", "Yes, it does.", "No, not at all.", "True.", "False.", "Correct.", "Of course."],
    ["Ja.", "Nein.", "Oui.", "Non.", "Sí.", "Sim.", "Natürlich.", "Bien sûr.", "Claro."],
    ["Every hour.", "Three times a week.", "Only on Mondays.", "At night.", "Each morning.", "Seldom.", "All the time."],
    ["Nachts.", "Jede Woche.", "Chaque jour.", "Le matin.", "Cada semana.", "De noche."],
    ["`max_size`", "`--force`", "config.yaml", "`retry()`", "v2.4.1", "2024-05-17", "HTTP 503"],
    ["Both.", "Neither.", "The first one.", "The operator.", "Two of them.", "All nodes.", "Beide.", "Les deux.", "Ambos."],
]

#: How a list begins; its last line ends without a full stop and is complete nonetheless.
LIST_HEADS = {"en": "The steps are:\n", "de": "Die Schritte sind:\n", "fr": "Les étapes sont :\n", "es": "Los pasos son:\n"}


def halves(families: list[list[str]], held: bool) -> list[list[str]]:
    """The families for calibration (every fifth) or those for training."""
    return [f for k, f in enumerate(families) if (k % 5 == 4) == held]
