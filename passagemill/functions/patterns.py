"""Patterns of the construction-document vocabulary, in Java's dialect.

Fixed values: word lists, formats and pattern alternatives are part of the results that operators
must give, so they are spelled out. Words end where neither letter, digit nor _ follows, which also
holds for the squared and cubed signs.
"""

from __future__ import annotations

import re
from re import _parser as parser

START, STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ANY_CASE = "(?iuU)"


def whole(words: str, flags: str = ANY_CASE) -> str:
    return f"{flags}{START}(?:{words}){STOP}"


def _needs(tree) -> list[str]:
    """Literals one of which stands in every match of a parsed pattern, the rarest such; none if that is not known."""
    rank = lambda literals: min((len(a) + (not a.isalnum()) for a in literals), default=0)
    best: list[str] = []
    run = ""
    for op, of in [*tree, (None, None)]:
        if op is parser.LITERAL:
            run += chr(of)
            continue
        found = [[run]] if run else []
        run = ""
        if op is parser.SUBPATTERN:
            found.append(_needs(of[3]))
        elif op is parser.BRANCH:
            parts = [_needs(part) for part in of[1]]
            found.append(sum(parts, []) if all(parts) else [])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and of[0]:
            found.append(_needs(of[2]))
        best = max([best, *found], key=rank)
    return best


def needed(pattern: str) -> list[str]:
    """Lower-case literals one of which a text has that the pattern is found in; none if too short to tell texts apart."""
    body = re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern).replace(r"\p{L}\p{N}", r"\w")
    found = dict.fromkeys(need.lower() for need in _needs(parser.parse(body)))
    # What holds another of them adds nothing.
    kept = [a for a in found if not any(b != a and b in a for b in found)]
    return kept if all(len(a) > 1 or not a.isalnum() for a in kept) else []


# Headings
LOT = r"(?iuU)^\s*LOT\s*[Nn°]*\s*(\d+)\s*[-–:.]\s*([^\n]+)"
ARTICLE = r"(?iuU)^\s*(?:Art(?:icle)?\.?\s+)?(\d+)[.\-](\d+)\s*[-–:.]\s*([^\n]+)"
SUBARTICLE = r"(?U)^\s*(\d+)[.\-](\d+)[.\-](\d+)\s*[-–:.)\s]\s*([^\n]+)"
ARTICLE_CUT = r"(?U)(?=(?:^|\n)(?:(?:Article|ARTICLE)\s+\d|(?:LOT|Lot)\s+\d|\d+\.\d+(?:\.\d+)?))"
POINT_CUT = r"(?U)(?=(?:^|\n)(?:\d+[.)]\s+\S[^\n]{9,}|Point\s+\d))"
POINT_HEADING = r"(?U)^\s*\d+[.)]\s+\S[^\n]{9,}"
SHEET_CUT = r"(?m)(?=^## )"

# Content signals
QUANTITY = whole("m[²³23]|ml|kg|[Uu]|ens|forfait", "(?uU)").replace(START, "(?=[mkUuef])" + START)
ADMIN = (
    "(?iuU)(?:conformément à|le titulaire devra|selon les règles|à la charge de|l'entrepreneur|prescriptions|"
    "obligation|responsabilité|réglementation|normes en vigueur)"
)
SPECIFICATION = (
    "(?iuU)(?:épaisseur|résistance|classe|type|dimension|section|diamètre|capacité|performance|coefficient|"
    r"conductivité|densité)\s*(?::|=|de\s)?\s*\d"
)
DESCRIPTION = whole("comprend|comporte|constitué|composé|réalisé|mis en œuvre|posé|fixé|scellé|coulé|appliqué|disposé")

# Keyword families
KEYWORDS = [
    whole(
        "béton|acier|bois|aluminium|PVC|zinc|cuivre|plomb|inox|verre|laine de (?:verre|roche)|polystyrène|"
        "polyuréthane|plâtre|mortier|ciment|gravier|sable|enrobé|bitume|ardoise|tuile|brique|parpaing|agglo|BA13|"
        "fermacell|OSB"
    ),
    whole(r"DTU\s+\d[\d\-.]*|NF\s*(?:EN\s*)?[A-Z]{0,2}\s*\d[\d\-.:]*|EN\s+\d[\d\-.]*", "(?uU)").replace(START, "(?=[DNE])" + START).removesuffix(STOP) + r"(?<=[\p{L}\p{N}_])" + STOP,
    whole(r"C\d{2}/\d{2}", "(?uU)"),
    whole(r"RAL\s*\d{4}", "(?uU)"),
    "(?uU)" + START + r"(?:Ug|Uw|R|Up|Ucw)\s*=\s*[\d.,]+",
    whole(
        "Knauf|Isover|Weber|Sika|Schüco|Schuco|Saint-Gobain|Velux|Grohe|Legrand|Schneider|Hager|Geberit|Rockwool|"
        "Placo|Siniat|Mapei|Parex|Hilti|Fischer|Rehau|Daikin|Atlantic|Thermor|Viessmann|Bosch|Giacomini|Caleffi|"
        "Grundfos|Wilo|ABB|Siemens"
    ),
    whole(
        "fondation|dalle|cloison|faux[- ]plafond|chape|étanchéité|gouttière|VRD|menuiserie|serrurerie|couverture|"
        "bardage|revêtement|carrelage|peinture|plomberie|ventilation|chauffage|électricité|isolation|doublage|"
        "escalier|garde[- ]corps|acrotère|seuil|appui|linteau|enduit|ravalement|terrasse|balcon|plancher"
    ),
    "(?iuU)" + START + r"\d+\s*[x×]\s*\d+(?:\s*[x×]\s*\d+)?\s*(?:mm|cm|m)" + STOP
    + r"|(?:ép(?:aisseur)?\.?\s*[:=]?\s*\d+\s*(?:mm|cm|m))|(?:[ØDd]\s*[:=]?\s*\d+\s*(?:mm|cm|m))"
    + r"|(?:[LlHh]\s*[:=]\s*\d+[.,]?\d*\s*(?:mm|cm|m))",
    whole(r"A[12](?:-s[12],d[012])?|M[0-4]|(?:EI|REI|E|R)\s*\d{2,3}|coupe[- ]feu|pare[- ]flamme|incombustible|ignifug[ée]").replace(START, "(?=[AMERCPI])" + START),
    whole(r"ACERMI|CSTB|CSTBat|Avis\s+Technique|marquage\s+CE|QB|HQE|BREEAM|LEED|Qualibat|RGE|Effinergie"),
    whole(
        "amiante|chrysotile|crocidolite|amosite|trémolite|actinolite|anthophyllite|MPCA|MCA|fibro[- ]ciment|"
        "amiante[- ]ciment|flocage|calorifugeage|déflocage|prélèvement|échantillon|sondage|"
        r"sous[- ]section\s*[1-4]|SS[1-4]"
    ),
    whole(r"positif|négatif|présence|absence|détecté|non\s+détecté|identifié|amianté|non\s+amianté|résultat|conclusion|diagnostic"),
]
LOCATION = whole(
    r"RDC|rez[- ]de[- ]chauss[ée]e|R\+\d|R-\d|sous[- ]sol|SS[- ]?\d|[ée]tage\s+\d+|niveau\s+\d+|toiture|terrasse|"
    r"façade|combles?|sanitaires?|hall|circulations?|parking|cave|local\s+technique|chaufferie|buanderie|"
    r"vide[- ]sanitaire|palier|cage\s+d['’]escalier"
)

# Diagnostic reports
BOILERPLATE = (
    r"(?iuU)(?:recommandations?\s+(?:générales?\s+)?(?:de\s+)?sécurité|ne\s+se\s+substitu(?:e|ent)\s+en\s+aucun\s+cas|"
    r"obligations?\s+réglementaires?\s+existant|l'émission\s+de\s+poussières?\s+peut\s+être\s+limitée|"
    r"déchets?\s+(?:amianté|lié|contenant)|installation\s+de\s+stockage\s+pour\s+déchets\s+dangereux|"
    r"code\s+de\s+l'environnement|sclérose\s*\(?asbestose\)?|insuffisance\s+respiratoire|mésothéliome|"
    r"article\s+L[\s.]?\d{3,4}[- ]\d+\s+du\s+code|diagnostiqueurs?\s+pour\s+la\s+gestion|"
    r"maintien\s+en\s+bon\s+état\s+de\s+conservation|installation\s+de\s+stockage\s+pour\s+déchets|"
    r"déchet\s+amianté\s+doit\s+être\s+éliminé|producteurs?\s+des?\s+déchets\s+au\s+sens|"
    r"filières?\s+(?:d')?élimination\s+(?:des?\s+)?déchets)"
)
RESULT_TABLE = (
    r"(?iuU)(?:(?:résultat|amiante)\s*[:\s]*(?:positif|négatif)|(?:positif|négatif)\s*[:\s]*(?:amiante|présence|absence)|"
    r"identifiant\s+(?:du\s+)?(?:matériau|prélèvement)|conclusion\s*\(?justification\)?|résultat\s+(?:d')?analyse|"
    r"composant.*résultat|localisation.*(?:conclusion|résultat)|n[°o]\s*(?:échantillon|prélèvement|rapport)|"
    r"(?:présence|absence)\s+d'amiante)"
)
CHECKLIST = r"(?iuUs)(?:composant\s+de\s+la\s+construction.*(?:à\s+vérifier|à\s+sonder)|partie\s+du\s+composant\s+(?:à\s+vérifier|ayant\s+été))"
CHECKLIST_SECTION = (
    r"(?iuU)(?:toiture\s+et\s+étanchéité|parois\s+verticales?\s+intérieures?|plafonds?\s+et\s+faux[- ]plafonds?|"
    r"planchers?\s+et\s+marches|equipements?\s+divers|conduits?\s+(?:de\s+)?(?:vapeur|fumée|liquides)|"
    r"gaines?\s+et\s+coffres?\s+verticaux|ascenseurs?\s+et\s+monte[- ]charge)"
)
RESULT_COLUMN = r"(?iuU)(?:conclusion|résultat|positif|négatif|absence\s+d)"
MISSION = r"(?iuU)(?:adresse\s+du\s+bâtiment|opérateur.*certifi|date.*(?:visite|commande|mission)|numéro\s+de\s+dossier|périmètre\s+de\s+repérage)"

REGULATORY = [r"article\s+[lr][\s.]?\d{3,4}", r"arrêté|décret|code\s+du\s+travail|code\s+de\s+la\s+santé", r"nf\s*x?\s*46[- ]0\d{2}"]

#: Python patterns one of which is in every lower-cased text that holds the pattern, which needs no literal; those
#: of the second table hold a digit.
ROUGHLY = {QUANTITY: r"(?<![a-z0-9_])(?:m[²³23]|ml|kg|u|ens|forfait)(?![a-z0-9_])"}
ROUGHLY_WITH_DIGIT = {
    KEYWORDS[1]: r"(?:dtu|en)\s+\d|nf\s*(?:en\s*)?[a-z]{0,2}\s*\d",
    KEYWORDS[7]: r"\d\s*[x×mc]|[:=]\s*\d",
    KEYWORDS[8]: r"[ameri]\s*\d",
}
#: What the alternatives of a pattern without a digit need.
WITHOUT_DIGIT = {KEYWORDS[8]: ["coupe", "pare", "incombustible", "ignifug"]}

# Cleaning and deduplication keys
TOC_LINE = r"(?U)^\s*\S.*\.{3,}\s*\d+\s*$"
LEADING_ARTICLE = r"(?iuU)^\s*(?:(?>\d+(?:\.\d+)+)\.|(?>\d+(?:\.\d+)+)(?!\s*(?:m[²³23]?|mm|cm|ml|kg|l|u)" + STOP + r"))\s*"
LOCALISATION_TAIL = r"(?iuU)(?:au droit|localisation\s*:)[^\n]*"
AMOUNT = r"(?uU)[\d.,]+\s*(?:m[²³23]?|ml|kg|l)" + STOP
EMPTY_TABLE = r"(?iuU)^<!-- TABLE -->\s*\n(?:\|[^\n]*\n){1,2}(?:\|[\s\-–—|Nn/Aaéant]*\n)*\s*<!-- /TABLE -->$"
EMPTY_ROW = r"(?iuU)^[\s|]*(?:néant|n[/.]?a|aucun|rien|sans\s+objet|-|–|—|\s)*$"
#: How a text of EMPTY_TEXTS begins, which is soon told of any other.
EMPTY_START = r"(?iuU)^\s*(?:néant|n/a|aucun|sans|[-–—]|$)"
EMPTY_TEXTS = ["néant", "n/a", "aucun", "sans objet", "-", "–", "—", ""]

# Instructions to a model inside a passage
INJECTION = [
    r"\b(ignore|oublie|disregard|forget)\w*\b[^.\n]{0,80}\b(previous|prior|above|precedent\w*|anterieur\w*|ci-dessus)\b",
    r"\btu es (desormais|maintenant)\b",
    r"\byou are now\b",
    r"\b(prompt|message|instructions?) (systeme|system)\b",
    r"\bsystem prompt\b",
    r"\b(appelle|utilise|call|invoke)\w*\b[^.\n]{0,40}\b(outil|tool|fonction|function)\b",
    r"\b(read_passage|search_documents)\b",
    r"<\s*/?\s*(documents?|manque)\b",
    r"\[/?inst\]|<\|im_(start|end)\|>",
]
FORMAT_CHARS = r"[­؀-؅؜​-‏‪-‮⁠-⁤⁦-⁯﻿]"

THERMAL_QUESTION = (
    r"(?iuU)re\s*2020|re2020|bbio|cep" + STOP + r"|performance\s+[ée]nerg[ée]tique|r[ée]glementation\s+thermique|"
    r"bilan\s+thermique|[ée]tude\s+thermique|consommation\s+[ée]nerg[ée]tique|d[ée]perdition"
)
THERMAL_TYPE = r"(?i)fiche.technique|bilan.thermique|etude.thermique"
THERMAL_FILE = r"(?i)bilan|thermique|re2020|bbio"
NORM_KEYWORD = r"(?i)^(?:dtu|nf|en)\s"
THERMAL_KEYWORD = (
    r"(?iu)(?:^(?:dtu|nf|en)\s|^(?:ug|uw|r|up|ucw)\s*=|^(?:acermi|cstb|cstbat|avis technique|marquage ce|effinergie|"
    r"hqe|rge|qualibat)|^(?:isolation|chauffage|ventilation|doublage|étanchéité|plancher|dalle|chape|"
    r"faux[- ]plafond|couverture|cloison)|^(?:laine de verre|laine de roche|polystyrène|polyuréthane)|"
    r"^(?:a[12](?:-s|$)|m[0-4]$|(?:ei|rei|e|r)\s*\d)|^c\d{2}/\d{2}$)"
)

DOCUMENT_TYPES = ["CCTP", "CR", "fiche_technique", "plan", "email", "estimatif", "DPGF", "etude_sol", "etude_thermique", "rapport_amiante", "rapport_diagnostic", "autre"]
PHASES = ["ESQ", "APS", "APD", "PRO", "DCE", "EXE"]
VERSIONED_TYPES = ["etude_thermique", "cctp", "dpgf", "etude_sol", "rapport_amiante"]
DIAGNOSTIC_TERMS = {
    "rapport_amiante": ["amiante", "désamiantage", "diagnostic", "repérage", "dta"],
    "etude_sol": ["sol", "géotechnique", "géotech", "sondage", "fondation", "g1", "g2"],
    "etude_thermique": ["thermique", "rt2012", "re2020", "déperdition", "bbio", "cep"],
}
CONTENT_SCORES = {"specification": 0.2, "description": 0.2, "mixed": 0.15, "quantity": 0.1, "admin": 0.1, "heading": 0.0}
CONTENT_PRIORITY = ["description", "specification", "mixed", "heading", "quantity", "admin"]
STEPS = [
    "rewrite", "rewrite_wait", "search", "enrich", "judge", "judge_wait", "retry_search", "enrich_retry", "generate",
    "generate_wait", "generate_first_token", "generate_stream", "extract_table", "extract_table_wait",
    "extract_schema", "extract_schema_wait",
]
