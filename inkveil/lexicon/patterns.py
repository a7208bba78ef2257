"""The pattern catalog: what each detector pattern matches, its type, base confidence and languages.

Languages are None where a pattern runs for every language. Patterns marked "i" ignore case.
"""

from __future__ import annotations

# The patterns, types, confidences, flags and languages below define the results.

EN, FR, DE, ES, IT, NL = (frozenset({x}) for x in ("en", "fr", "de", "es", "it", "nl"))
EN_FR, BE, PT = frozenset({"en", "fr"}), frozenset({"fr", "nl", "de"}), frozenset({"pt", "es"})

#: Building blocks of the names and firms below.
NAME_TAIL = r"[ \t]+[A-ZÀ-Ü][a-zà-ü]{1,20}(?:[ \t]+[A-ZÀ-Ü][a-zà-ü]{1,20}){0,3}\b"
NAME = r"[A-ZÀ-Ü][a-zà-ü]{1,20}(?:[ \t]+[A-ZÀ-Ü][a-zà-ü]{1,20}){0,3}\b"
TOWN = r"[ \t]+[A-ZÀ-Ü][a-zà-ü]+(?:(?:[^\S\n]|-)[A-ZÀ-Üa-zà-ü]+){0,3}\b"
FIRM = r"[A-ZÀ-Ü][a-zA-Zà-üÀ-Ü\-']{1,25}"
FIRM_AND = r"[A-ZÀ-Ü][a-zA-Zà-üÀ-Ü&\-']{1,30}"
FIRM_PLAIN = r"[A-ZÀ-Ü][a-zA-Zà-üÀ-Ü\-]{1,25}"
FIRM_DOT = r"[A-ZÀ-Ü][a-zA-Zà-üÀ-Ü.\-']{1,25}"
HEADED = r"\b[A-ZÀ-Ü][a-zA-Zà-üÀ-Ü\-']{2,25}(?:\s+[A-ZÀ-Ü][a-zA-Zà-üÀ-Ü\-']{2,25}){1,3}(?=\s*\n\s*(?:"
MONTHS_EN = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
FORMS_DE = r"GmbH|AG|KG|KGaA|OHG|e\.?K\.?|UG|mbH|e\.?V\.?"
FORMS_EN = r"Inc|Corp|LLC|Ltd|LLP|PLC|Co|LP|SAS"
GMBH_CO = r"GmbH\s*&\s*Co\.?\s*(?:KG|OHG|KGaA)"
FORMS_ROMANCE = r"S\.?A\.?R\.?L\.?|S\.A\.?|S\.?L\.?U?\.?|S\.?C\.?|S\.?R\.?L\.?|S\.?p\.?A\.?|S\.?a\.?s\.?|S\.?n\.?c\.?"

#: (type, base confidence, languages, flags, pattern)
STANDALONE = [
    ("EMAIL", 0.98, None, "", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("SSN", 0.50, EN, "", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("SSN", 0.40, EN, "", r"\b\d{3}\s\d{2}\s\d{4}\b"),
    ("SSN", 0.60, FR, "", r"\b[12]\s?\d{2}\s?(?:0[1-9]|[1-9]\d)\s?\d{2,3}\s?\d{3}\s?\d{3}(?:\s?\d{2})?\b"),
    ("SSN", 0.65, EN, "", r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b"),
    ("SSN", 0.45, ES, "", r"\b\d{8}[A-Z]\b"),
    ("SSN", 0.55, ES, "", r"\b[XYZ]\d{7}[A-Z]\b"),
    ("SSN", 0.70, IT, "", r"\b[A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z]\b"),
    ("SSN", 0.60, BE, "", r"\b\d{2}\.\d{2}\.\d{2}[-]\d{3}\.\d{2}\b"),
    ("SSN", 0.25, NL, "", r"\b\d{9}\b"),
    ("SSN", 0.30, PT, "", r"\b[12356789]\d{8}\b"),
    ("PHONE", 0.92, EN_FR, "", r"(?:\b1[-.\s])?\(\d{3}\)\s?\d{3}[-.\s]?\d{4}"),
    ("PHONE", 0.90, EN_FR, "", r"\b1[-.\s]\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("PHONE", 0.70, EN_FR, "", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("PHONE", 0.88, None, "", r"\(?\+\d{1,3}\)?[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,4}(?:[-.\s]?\d{2,4})?"),
    ("PHONE", 0.90, FR, "", r"(?:(?:\+|00)33\s?|0)[1-9](?:[\s.\-]?\d{2}){4}"),
    ("PHONE", 0.50, EN, "", r"\b0[1-9]\d{1,3}\s?\d{3,4}\s?\d{3,4}\b"),
    ("PHONE", 0.85, DE, "", r"(?:(?:\+|00)49\s?|0)\d{2,4}[\s/\-]?\d{3,4}[\s\-]?\d{3,5}"),
    ("PHONE", 0.80, ES, "", r"(?:(?:\+|00)34\s?)?\b(?:9[0-8]\d|[6-7]\d{2})\s?\d{2,3}\s?\d{2}\s?\d{2}\b"),
    ("PHONE", 0.80, IT, "", r"(?:(?:\+|00)39\s?)?(?:0[1-9]\d{0,2}|3[0-9]{2})[\s\-]?\d{3,4}[\s\-]?\d{3,4}"),
    ("PHONE", 0.80, NL, "", r"(?:(?:\+|00)31\s?|0)\d{1,3}[\s\-]?\d{3,4}[\s\-]?\d{3,4}"),
    ("PHONE", 0.80, PT, "", r"(?:(?:\+|00)351\s?)?\b(?:2\d|9[1-6])\d?\s?\d{3}\s?\d{3,4}\b"),
    ("PHONE", 0.90, EN_FR, "", r"\b1[-.\s]?8(?:00|44|55|66|77|88)[-.\s]?\d{3}[-.\s]\d{4}\b"),
    ("CREDIT_CARD", 0.90, None, "", r"\b\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}\b"),
    ("CREDIT_CARD", 0.40, None, "", r"\b[3-6]\d{15}\b"),
    ("CREDIT_CARD", 0.90, None, "", r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b"),
    ("IBAN", 0.85, None, "", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,8}(?:\s?[A-Z0-9]{1,4})?\b"),
    ("DATE", 0.35, None, "", r"\b\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4}\b"),
    ("DATE", 0.35, None, "", r"\b\d{4}[/\-]\d{1,2}[/\-]\d{1,2}\b"),
    ("DATE", 0.60, None, "i", r"\b" + MONTHS_EN + r"\s+\d{1,2},?\s+\d{4}\b"),
    ("DATE", 0.60, None, "i", r"\b\d{1,2}\s+" + MONTHS_EN + r"\s+\d{4}\b"),
    ("DATE", 0.60, None, "i", r"\b\d{1,2}(?:er)?\s+(?:janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[ée]cembre)\s+\d{4}\b"),
    ("DATE", 0.60, None, "i", r"\b\d{1,2}\.\s*(?:Januar|Februar|M[aä]rz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s+\d{4}\b"),
    ("DATE", 0.50, None, "i", r"\b\d{1,2}\s+(?:de\s+)?(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)(?:\s+(?:de\s+)?\d{4})?\b"),
    ("DATE", 0.60, None, "i", r"\b\d{1,2}\s+(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\s+\d{4}\b"),
    ("DATE", 0.60, None, "i", r"\b\d{1,2}\s+(?:januari|februari|maart|april|mei|juni|juli|augustus|september|oktober|november|december)\s+\d{4}\b"),
    ("DATE", 0.55, None, "i", r"\b\d{1,2}\s+(?:de\s+)?(?:janeiro|fevereiro|mar[çc]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)(?:\s+(?:de\s+)?\d{4})?\b"),
    ("IP_ADDRESS", 0.85, None, "", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("IP_ADDRESS", 0.80, None, "", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("PASSPORT", 0.35, None, "", r"\b(?!(?:FR|DE|ES|IT|BE|NL|AT|PT|PL|SE|DK|FI|IE|LU|GB|CH|US|CA)\d)[A-Z]{2}\d{7}\b"),
    ("PASSPORT", 0.40, DE, "", r"\b[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}\b"),
    ("PASSPORT", 0.40, FR, "", r"\b\d{2}[A-Z]{2}\d{5}\b"),
    ("DRIVER_LICENSE", 0.75, EN, "", r"\b[A-Z]\d{3}-\d{4}-\d{4}\b"),
    ("DRIVER_LICENSE", 0.30, EN, "", r"\b[A-Z]{1,2}\d{7,8}\b"),
    ("ADDRESS", 0.80, None, "i", r"\b\d{1,5}[^\S\n]+(?:[NSEW]\.?[^\S\n]+)?[A-Z][a-z]+(?:[^\S\n]+[A-Z][a-z]+){0,2}[^\S\n]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct|Circle|Cir|Place|Pl|Terrace|Ter|Parkway|Pkwy|Highway|Hwy|Trail|Trl)\b\.?"),
    ("ADDRESS", 0.82, None, "i", r"\b\d{1,5}(?:[^\S\n]*(?:bis|ter))?,?[^\S\n]+(?:rue|avenue|av\.|boulevard|blvd|impasse|all[ée]e|chemin|place|cours|passage|square|quai|route|voie|sentier|mont[ée]e|rang|c[ôo]te|ruelle|croissant|promenade)(?:[^\S\n]+(?:de[^\S\n]+(?:la[^\S\n]+|l[''])?|du[^\S\n]+|des[^\S\n]+|d[''][^\S\n]*))?[^\S\n]*[A-ZÀ-Ü][a-zà-ü\-]+(?:[^\S\n,]+[A-ZÀ-Üa-zà-ü0-9\-]+){0,6}\b"),
    ("ADDRESS", 0.80, None, "i", r"\b[A-ZÀ-Ü][a-zà-ü]+(?:stra[ßs]e|str\.?|weg|gasse|platz|ring|damm|allee|ufer)[^\S\n]+\d{1,5}[a-z]?\b"),
    ("ADDRESS", 0.82, None, "i", r"\b(?:Via|Viale|V\.le|Piazza|P\.zza|Piazzale|Corso|C\.so|Largo|Vicolo|Lungomare|Vico|Contrada|Traversa|Salita|Galleria)[^\S\n]+[A-ZÀ-Ü][a-zà-ü\-']+(?:[^\S\n]+(?:di|del|della|dei|delle|dello|d[ae]l))?[^\S\n]*(?:[A-ZÀ-Ü][a-zà-ü\-']+[^\S\n]*){0,2}(?:[,]?[^\S\n]*\d{1,5}[/a-zA-Z]?)?\b"),
    ("ADDRESS", 0.82, None, "i", r"\b(?:Calle|Avenida|Avda|Paseo|Plaza|Plza|Camino|Carrera|Ronda|Travesía|Traves[ií]a|Glorieta|Alameda|Bulevar|Callejón|Callejon)(?:[^\S\n]+(?:de[^\S\n]+(?:la[^\S\n]+|las?[^\S\n]+|los?[^\S\n]+)?|del[^\S\n]+))?[^\S\n]*[A-ZÀ-Ü][a-zà-ü\-']+(?:[^\S\n]+[A-ZÀ-Ü][a-zà-ü\-']+){0,2}(?:[,]?[^\S\n]*(?:n[°º]\.?[^\S\n]*)?\d{1,5}[/a-zA-Z]?)?\b"),
    ("ADDRESS", 0.80, None, "i", r"\b[A-ZÀ-Ü][a-zà-ü]+(?:straat|laan|weg|gracht|plein|dijk|kade|singel|steeg|pad)[^\S\n]+\d{1,5}[a-z]?\b"),
    ("ADDRESS", 0.82, None, "i", r"\b(?:Rua|Avenida|Av\.|Praça|Praca|Travessa|Largo|Alameda|Estrada|Calçada|Calcada|Beco)(?:[^\S\n]+(?:da[^\S\n]+|do[^\S\n]+|dos[^\S\n]+|das[^\S\n]+|de[^\S\n]+))?[^\S\n]*[A-ZÀ-Ü][a-zà-ü\-']+(?:[^\S\n]+[A-ZÀ-Ü][a-zà-ü\-']+){0,2}(?:[,]?[^\S\n]*(?:n[°º]\.?[^\S\n]*)?\d{1,5}[/a-zA-Z]?)?\b"),
    ("ADDRESS", 0.75, None, "i", r"\b(?:P\.?O\.?[^\S\n]*Box|BP|Bo[iî]te[^\S\n]*postale|Postfach|Apartado|Casella[^\S\n]+[Pp]ostale|C\.?P\.?)[^\S\n]+\d+\b"),
    ("ADDRESS", 0.70, None, "", r"\b(?<!\d)(?:0[1-9]|[1-9]\d)\d{3}(?!\d)\b(?=[ \t]+[A-ZÀ-Ü])"),
    ("ADDRESS", 0.82, None, "", r"\b(?:F-?[^\S\n]*)?(?:0[1-9]|[1-9]\d)\d{3}" + TOWN),
    ("ADDRESS", 0.85, None, "", r"\b(?:0[1-9]|[1-9]\d)\d{3}[ \t]+[A-ZÀ-Ü][a-zà-ü]+(?:(?:[^\S\n]|-)[A-ZÀ-Üa-zà-ü]+){0,2}[^\S\n]+[Cc][Ee][Dd][Ee][Xx](?:[^\S\n]+\d{1,2})?\b"),
    ("ADDRESS", 0.75, None, "", r"\b(?:D-?[^\S\n]*)?\d{5}" + TOWN),
    ("ADDRESS", 0.80, None, "i", r"\b[A-Z]{1,2}\d[A-Z\d]?[^\S\n]*\d[A-Z]{2}\b"),
    ("ADDRESS", 0.70, None, "", r"\b\d{5}-\d{4}\b"),
    ("ADDRESS", 0.75, None, "", r"\bB-?[^\S\n]*\d{4}" + TOWN),
    ("ADDRESS", 0.75, NL, "", r"\b\d{4}[^\S\n]?[A-Z]{2}\b"),
    ("ADDRESS", 0.75, None, "", r"\bCH-?[^\S\n]*\d{4}" + TOWN),
    ("ADDRESS", 0.80, None, "", r"\b(?:I-?[^\S\n]*)?\d{5}[ \t]+(?:Roma|Milano|Napoli|Torino|Firenze|Venezia|Bologna|Genova|Palermo|Catania|Bari|Verona|Padova|Trieste|Brescia|Parma|Modena|Reggio|Perugia|Livorno|Cagliari|Foggia|Salerno|Ferrara|Rimini|Siracusa|Sassari|Monza|Bergamo|Taranto|Vicenza|Treviso|Novara|Piacenza|Ancona|Andria|Udine|Arezzo|Lecce|Pesaro|Alessandria|Pisa)\b(?:(?:[^\S\n]|-)[A-ZÀ-Üa-zà-ü]+){0,2}"),
    ("ADDRESS", 0.75, None, "", r"\bI-?[^\S\n]*\d{5}" + TOWN),
    ("ADDRESS", 0.75, None, "", r"\bE-?[^\S\n]*\d{5}" + TOWN),
    ("ADDRESS", 0.80, None, "", r"\b\d{4}-\d{3}" + TOWN),
    ("ADDRESS", 0.80, None, "i", r"\b[A-Z]\d[A-Z](?:[^\S\n]|-)?\d[A-Z]\d\b"),
    ("LOCATION", 0.55, None, "", r"\b(?:Paris|Lyon|Marseille|Toulouse|Nice|Nantes|Strasbourg|Montpellier|Bordeaux|Lille|Rennes|Reims|Toulon|Grenoble|Dijon|Angers|Nîmes|Aix-en-Provence|Saint-[ÉE]tienne|Clermont-Ferrand|Le\s+Havre|Le\s+Mans|Amiens|Limoges|Tours|Metz|Besançon|Perpignan|Orléans|Caen|Mulhouse|Rouen|Nancy|London|Manchester|Birmingham|Leeds|Glasgow|Liverpool|Edinburgh|Bristol|New\s+York|Los\s+Angeles|Chicago|Houston|Phoenix|San\s+Francisco|San\s+Diego|Dallas|Austin|Seattle|Denver|Boston|Miami|Atlanta|Washington|Philadelphia|Detroit|Minneapolis|Berlin|Munich|München|Hamburg|Frankfurt|Cologne|Köln|Stuttgart|Düsseldorf|Leipzig|Dortmund|Essen|Dresden|Bremen|Hannover|Madrid|Barcelona|Valencia|Seville|Sevilla|Zaragoza|Málaga|Bilbao|Rome|Roma|Milan|Milano|Naples|Napoli|Turin|Torino|Florence|Firenze|Venice|Venezia|Bologna|Genoa|Genova|Palermo|Amsterdam|Rotterdam|The\s+Hague|Utrecht|Brussels|Bruxelles|Antwerp|Anvers|Ghent|Gent|Liège|Zürich|Zurich|Geneva|Genève|Basel|Bern|Lausanne|Lisbon|Lisboa|Porto|Vienna|Wien|Salzburg|Graz|Dublin|Cork|Toronto|Montreal|Montréal|Vancouver|Ottawa|Calgary|Edmonton|Sydney|Melbourne|Brisbane|Perth|Auckland|Tokyo|Osaka|Beijing|Shanghai|Singapore|Hong\s+Kong|Seoul|Mumbai|Delhi)\b"),
    ("LOCATION", 0.50, None, "i", r"\b(?:France|Germany|Deutschland|United\s+Kingdom|United\s+States|Italia|Italy|España|Spain|Portugal|Netherlands|Nederland|Belgium|Belgique|België|Switzerland|Suisse|Schweiz|Svizzera|Austria|Österreich|Ireland|Irlande|Luxembourg|Denmark|Danmark|Sweden|Sverige|Norway|Norge|Finland|Poland|Polska|Czech\s+Republic|Czechia|Hungary|Romania|Greece|Grèce|Croatia|Slovenia|Slovakia|Bulgaria|Canada|Mexico|México|Brazil|Brasil|Argentina|Colombia|Chile|Australia|New\s+Zealand|Japan|Japon|China|Chine|India|Inde|South\s+Korea|Russia|Russie|Turkey|Turquie|United\s+Arab\s+Emirates|Saudi\s+Arabia|Israel|Egypt|Égypte|South\s+Africa|Nigeria|Morocco|Maroc|Tunisia|Tunisie|Algeria|Algérie|Senegal|Sénégal|Ivory\s+Coast|Côte\s+d['']Ivoire|Cameroon|Cameroun)\b"),
    ("PERSON", 0.88, EN, "", r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Sir|Madam|Capt|Sgt|Lt|Col|Gen)\.?[ \t]+[A-Z][a-z]{1,20}(?:[ \t]+[A-Z][a-z]{1,20}){0,3}\b"),
    ("PERSON", 0.88, FR, "", r"\b(?:M\.|Mme|Mlle)" + NAME_TAIL),
    ("PERSON", 0.88, DE, "", r"\b(?:Herr|Frau)\.?" + NAME_TAIL),
    ("PERSON", 0.85, ES, "", r"\b(?:Sr|Sra|Srta|Don|Do[ñn]a)\.?" + NAME_TAIL),
    ("PERSON", 0.85, IT, "", r"\b(?:Sig|Sig\.ra|Sig\.na)\.?" + NAME_TAIL),
    ("PERSON", 0.85, NL, "", r"\b(?:Dhr|Mw|Mevr|Ir|Ing|Drs|Mr|Ds)\.?[ \t]+(?:(?:de|van|den|der|het|ten|ter|te)\s+)*" + NAME),
    ("PERSON", 0.85, PT, "", r"\b(?:Sr|Sra|Srta|Dr|Dra|Prof|Eng)\.?[ \t]+(?:(?:de|da|do|dos|das)\s+)*" + NAME),
    ("ORG", 0.90, None, "", r"\b" + FIRM + r"(?:\s+" + FIRM + r"){0,4}\s+(?:(?i:SAS|SARL|EURL|SCI|SNC|SENC|S\.?E\.?N\.?C\.?)|SA|SE)\b\.?"),
    ("ORG", 0.92, None, "", r"\b\d{4,10}\s+" + FIRM + r"(?:\s+" + FIRM + r"){0,3}\s+(?i:Inc|Corp|LLC|Ltd|LLP|Ltée|Limitée|Enr|S\.?E\.?N\.?C\.?)\b\.?"),
    ("ORG", 0.88, None, "", r"\b" + FIRM_AND + r"(?:\s+" + FIRM_AND + r"){0,4}\s+(?:(?i:" + FORMS_EN + "|" + FORMS_DE + r"|BV|B\.?V\.?|NV|N\.?V\.?|V\.?O\.?F\.?|C\.?V\.?|" + FORMS_ROMANCE + r"|S\.?s\.?|S\.?Coop\.?|Lt[ée]e|Limit[ée]e|Lda|Ltda|A/S|ApS|ASA|AB|Oy|Oyj|HB|KB)|SA|SE|AS)\b\.?"),
    ("ORG", 0.92, None, "", r"\b" + FIRM_AND + r"(?:\s+" + FIRM_AND + r"){0,4}\s+(?:(?i:" + GMBH_CO + r"|SE\s*&\s*Co\.?\s*KGaA|UG\s*\(haftungsbeschr[äa]nkt\)))\b\.?"),
    ("ORG", 0.90, None, "", r"\b(?:\d{1,2}\.\s*)?" + FIRM_PLAIN + r"(?:\s+" + FIRM_PLAIN + r"){0,4}\s+(?i:e\.?\s?V\.?)\b\.?"),
    ("ORG", 0.92, None, "", r'["“„«][^"”‟»]{3,60}["”‟»]\s+' + FIRM_PLAIN + r"(?:\s+" + FIRM_PLAIN + r"){0,2}\s+(?:(?i:" + FORMS_DE + "|" + GMBH_CO + "|" + FORMS_EN + r"|S\.?A\.?R\.?L\.?|S\.A\.?|S\.?R\.?L\.?)|SA|SE|AS)\b\.?"),
    ("ORG", 0.85, None, "", r"\b(?:Groupe|Soci[ée]t[ée]|Compagnie|[ÉE]tablissements?|Ets|Cabinet|Maison|Group|Company|Corporation|Association|Foundation|Trust|Firma|Gesellschaft|Verein|Stiftung|Konzern|Grupo|Empresa|Compa[ñn][ií]a|Asociaci[óo]n|Fundaci[óo]n|Corporaci[óo]n|Gruppo|Societ[àa]|Azienda|Impresa|Associazione|Fondazione|Companhia|Associa[çc][ãa]o|Funda[çc][ãa]o|Groep|Bedrijf|Stichting|Vereniging|Maatschappij)\s+" + FIRM + r"(?:\s+" + FIRM + r"){0,3}\b"),
    ("ORG", 0.90, None, "", r"\b" + FIRM_DOT + r"(?:\s+" + FIRM_DOT + r"|\s+(?i:de|du|des|la|le|les|l'|d'|et|en|aux|au|à|del|los|las|el|y|para|di|della|delle|dei|degli|il|lo|per|da|do|dos|das|o|os|as|und|f[üu]r|der|die|das|den|dem|von|zu|zur|zum|van|het|voor|bij|op)\s+[a-zA-ZÀ-üÀ-Ü][a-zA-Zà-üÀ-Ü.\-']{1,25}|\s+[a-zà-ü][a-zA-Zà-üÀ-Ü.\-']{1,25}){1,5}\s+(?:(?i:Lt[ée]e|Limit[ée]e|" + FORMS_EN + r"|SARL|EURL|SCI|SNC|SENC|S\.?E\.?N\.?C\.?|Enr\.?g?\.?|" + FORMS_DE + "|" + GMBH_CO + r"|BV|B\.?V\.?|NV|N\.?V\.?|V\.?O\.?F\.?|C\.?V\.?|" + FORMS_ROMANCE + r"|S\.?s\.?|S\.?Coop\.?|Lda|Ltda|A/S|ApS|ASA|AB|Oy|Oyj|HB|KB)|SA|SE|AS)\b\.?"),
    ("ORG", 0.90, None, "", r"\b\d{3,10}(?:-\d{3,10})?\s+(?:[A-ZÀ-Ü][a-zA-Zà-üÀ-Ü\-']{2,20}\s+){1,3}(?:(?i:" + FORMS_EN + "|" + FORMS_DE + "|" + GMBH_CO + r"|BV|B\.?V\.?|NV|N\.?V\.?|" + FORMS_ROMANCE + r"|Lt[ée]e|Limit[ée]e|Lda|Ltda|Enr\.?g?\.?|A/S|ApS|ASA|AB|Oy|Oyj)|SA|SE|AS)\b\.?"),
    ("ORG", 0.88, FR, "i", HEADED + r"[ÉE]TAT\s+(?:DES\s+R[ÉE]SULTATS|DU\s+CAPITAL|FINANCIER)|BILAN|COMPTE\s+DE\s+R[ÉE]SULTAT|BUDGET|RAPPORT\s+(?:ANNUEL|FINANCIER)))"),
    ("ORG", 0.88, EN, "i", HEADED + r"INCOME\s+STATEMENT|BALANCE\s+SHEET|STATEMENT\s+OF\s+(?:FINANCIAL\s+POSITION|CASH\s+FLOWS|OPERATIONS)|PROFIT\s+AND\s+LOSS|ANNUAL\s+REPORT|FINANCIAL\s+STATEMENTS?))"),
    ("ORG", 0.88, DE, "i", HEADED + r"BILANZ|GEWINN-?\s*UND\s*VERLUSTRECHNUNG|JAHRESABSCHLUSS|LAGEBERICHT|KAPITALFLUSSRECHNUNG|GESCH[ÄA]FTSBERICHT|ERFOLGSRECHNUNG|ANHANG\s+ZUM\s+JAHRESABSCHLUSS))"),
    ("ORG", 0.88, ES, "i", HEADED + r"BALANCE\s+(?:GENERAL|DE\s+SITUACI[ÓO]N)|ESTADO\s+DE\s+RESULTADOS|CUENTA\s+DE\s+(?:P[ÉE]RDIDAS\s+Y\s+GANANCIAS|RESULTADOS)|INFORME\s+(?:ANUAL|FINANCIERO)|MEMORIA\s+ANUAL))"),
    ("ORG", 0.88, IT, "i", HEADED + r"BILANCIO|CONTO\s+ECONOMICO|STATO\s+PATRIMONIALE|RENDICONTO\s+FINANZIARIO|RELAZIONE\s+(?:SULLA\s+GESTIONE|ANNUALE)|NOTA\s+INTEGRATIVA))"),
    ("ORG", 0.88, NL, "i", HEADED + r"BALANS|WINST-?\s*EN\s*VERLIESREKENING|JAARREKENING|RESULTATENREKENING|KASSTROOMOVERZICHT|JAARVERSLAG|TOELICHTING))"),
    ("CUSTOM", 0.40, None, "", r"\b(?:FR|DE|ES|IT|BE|NL|AT|PT|PL|SE|DK|FI|IE|LU|CZ|SK|HU|RO|BG|HR|SI|EE|LV|LT|CY|MT|GR|EL|GB)[A-Z0-9]{8,12}\b"),
    ("CUSTOM", 0.35, None, "", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    ("CUSTOM", 0.40, FR, "", r"\b\d{3}\s\d{3}\s\d{3}\b"),
    ("CUSTOM", 0.55, FR, "", r"\b\d{3}\s\d{3}\s\d{3}\s\d{5}\b"),
    ("CUSTOM", 0.50, FR, "", r"\b\d{3}[.\s]?\d{3}[.\s]?\d{3}[.\s]?\d{5}\b"),
    ("CUSTOM", 0.70, DE, "", r"\bHR[AB]\s?\d{3,7}(?:\s?[A-Z])?\b"),
    ("SSN", 0.35, EN, "", r"\b\d{2}-\d{7}\b"),
    ("CUSTOM", 0.45, ES, "", r"\b[ABCDEFGHJNPQRSUVW]\d{7}[A-J0-9]\b"),
    ("CUSTOM", 0.25, IT, "", r"\b\d{11}\b"),
    ("SSN", 0.30, EN, "", r"\b\d{3}\s\d{3}\s\d{4}\b"),
    ("SSN", 0.20, EN, "", r"\b\d{10}\b"),
    ("SSN", 0.35, DE, "", r"\b[A-Z]\d{9}\b"),
    ("SSN", 0.35, DE, "", r"\b[CFGHJKLMNPRTVWXYZ]\d{2}[0-9CFGHJKLMNPRTVWXYZ]{6}\b"),
    ("SSN", 0.40, IT, "", r"\b[A-Z]{2}\s?\d{5}[A-Z]{2}\b"),
    ("IBAN", 0.70, EN, "", r"\b\d{2}-\d{2}-\d{2}\s+\d{8}\b"),
    ("IBAN", 0.30, EN, "", r"\b\d{9}\s+\d{6,17}\b"),
    ("SSN", 0.20, PT, "", r"\b\d{11}\b"),
    ("SSN", 0.30, ES, "", r"\b[A-Z]{2}\d{12}\b"),
    ("CUSTOM", 0.70, None, "i", r"\b(?:MRN|MR|PAT|DOS)\s*[-:]\s*[A-Z0-9]{4,12}\b"),
    ("CUSTOM", 0.22, None, "", r"\b[A-Z]{3,4}\d{7,12}\b"),
    ("LOCATION", 0.75, None, "", r"\b-?\d{1,3}\.\d{4,8},\s*-?\d{1,3}\.\d{4,8}\b"),
    ("SSN", 0.25, None, "", r"\b\d{6}[-+]?\d{4}\b"),
    ("SSN", 0.30, None, "", r"\b\d{6}-\d{4}\b"),
    ("SSN", 0.35, None, "", r"\b\d{6}[A+\-]\d{3}[0-9A-Y]\b"),
    ("SSN", 0.35, None, "", r"\b\d{6}/\d{3,4}\b"),
    ("SSN", 0.15, None, "", r"\b\d{8}\b"),
    ("SSN", 0.30, None, "", r"\b[1-8]\d{12}\b"),
    ("PASSPORT", 0.25, IT, "", r"\b[A-Z]{2}\d{7}\b"),
    ("PASSPORT", 0.25, ES, "", r"\b[A-Z]{3}\d{6}\b"),
    ("PASSPORT", 0.25, FR, "", r"\b\d{2}[A-Z]{2}\d{5}\b"),
    ("PASSPORT", 0.25, DE, "", r"\b[CFGHJK][0-9CFGHJKLMNPRTVWXYZ]{8}\b"),
    ("DATE", 0.35, None, "", r"\b(?:0[1-9]|[12]\d|3[01])[/\-.](?:0[1-9]|1[0-2])[/\-.]\d{2}\b"),
]

VALUE = r"[ \t]*[:][ \t]*"
AFTER = r"[ \t]*[:]?[ \t]*"
NUMBER = r"[ \t]*(?:No\.?|Number|Num[ée]ro|#|N°)?[ \t]*[:]?[ \t]*"
WHO = r"([A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,20}(?:[ \t]+[A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,20}){0,3})"
WHO_EN = r"([A-Z][a-zA-Z'\-]{1,20}(?:[ \t]+[A-Z][a-zA-Z'\-]{1,20}){1,3})"
WHO_NL = r"(?:(?:de|van|den|der|het|ten|ter|te)\s+)*" + WHO
WHO_PT = r"(?:(?:de|da|do|dos|das)\s+)*" + WHO
SIGNER = r"[A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,25}(?:[ \t]+[A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,25}){1,3})"

#: Label, then the value as the one group; no exclusion gate is applied to these.
LABELLED = [
    ("PERSON", 0.85, EN, "", r"(?:(?:First|Last|Full|Middle|Sur|Family|Given|Maiden)[ \t]*[Nn]ame|[Nn]ame)" + VALUE + WHO_EN),
    ("PERSON", 0.85, EN, "i", r"(?:Patient|Client|Applicant|Employee|Insured|Beneficiary|Claimant|Defendant|Plaintiff|Suspect|Witness|Victim|Tenant|Owner|Buyer|Seller)" + VALUE + WHO_EN),
    ("PERSON", 0.85, FR, "", r"(?:Nom|Pr[ée]nom|Nom de famille|Nom complet|Identit[ée])" + VALUE + WHO),
    ("PERSON", 0.85, FR, "i", r"(?:Patient|Client|Employ[ée]|Salari[ée]|B[ée]n[ée]ficiaire|Assur[ée]|Locataire|Propri[ée]taire|D[ée]fendeur|Demandeur)" + VALUE + WHO),
    ("PERSON", 0.85, DE, "", r"(?:Vorname|Nachname|Familienname|Name)" + VALUE + WHO),
    ("PERSON", 0.85, IT, "", r"(?:Nome|Cognome|Nome\s+completo|Nominativo|Intestatario)" + VALUE + WHO),
    ("PERSON", 0.85, IT, "i", r"(?:Paziente|Assistito|Assicurato|Inquilino|Proprietario|Richiedente|Imputato|Attore|Convenuto|Testimone|Acquirente|Venditore)" + VALUE + WHO),
    ("PERSON", 0.85, ES, "", r"(?:Nombre|Apellido|Nombre\s+completo)" + VALUE + WHO),
    ("PERSON", 0.85, ES, "i", r"(?:Paciente|Cliente|Empleado|Asegurado|Solicitante|Demandante|Demandado|Testigo|Comprador|Vendedor|Arrendatario|Propietario)" + VALUE + WHO),
    ("PERSON", 0.85, NL, "", r"(?:Naam|Voornaam|Achternaam|Volledige\s+naam)" + VALUE + WHO_NL),
    ("PERSON", 0.85, NL, "i", r"(?:Pati[ëe]nt|Cli[ëe]nt|Werknemer|Verzekerde|Aanvrager|Gedaagde|Eiser|Getuige|Koper|Verkoper|Huurder|Eigenaar)" + VALUE + WHO_NL),
    ("PERSON", 0.85, PT, "", r"(?:Nome|Apelido|Nome\s+completo)" + VALUE + WHO_PT),
    ("PERSON", 0.85, PT, "i", r"(?:Paciente|Cliente|Empregado|Segurado|Requerente|R[ée]u|Autor|Testemunha|Comprador|Vendedor|Inquilino|Propriet[áa]rio)" + VALUE + WHO_PT),
    ("PASSPORT", 0.88, None, "i", r"(?:Passport|Passeport|Reisepass|Passaporto|Pasaporte)" + NUMBER + r"([A-Z0-9]{6,9})"),
    ("DRIVER_LICENSE", 0.88, None, "i", r"(?:Driver'?s?\s*Licen[cs]e|DL|Permis\s*(?:de\s*)?conduire|F[üu]hrerschein|Patente(?:\s*di\s*guida)?|Licencia(?:\s*de\s*conducir)?)" + NUMBER + r"([A-Z0-9\-]{6,15})"),
    ("SSN", 0.92, EN, "i", r"(?:SSN|Social\s*Security|Tax\s*ID|TIN)[ \t]*(?:No\.?|Number|#|N°)?" + AFTER + r"(\d{3}[-\s]?\d{2}[-\s]?\d{4})"),
    ("SSN", 0.92, FR, "i", r"(?:N°\s*(?:de\s*)?(?:s[ée]curit[ée]\s*sociale|s[ée]cu|SS)|Num[ée]ro\s*(?:de\s*)?(?:s[ée]curit[ée]\s*sociale|s[ée]cu|SS)|NIR)" + AFTER + r"([12]\s?\d{2}\s?(?:0[1-9]|1[0-2]|[2-9]\d)\s?\d{2,3}\s?\d{3}\s?\d{3}(?:\s?\d{2})?)"),
    ("SSN", 0.92, EN, "i", r"(?:National\s*Insurance|NI|NINO)[ \t]*(?:No\.?|Number|#|N°)?" + AFTER + r"([A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])"),
    ("SSN", 0.92, NL, "i", r"(?:BSN|Burgerservicenummer|Sofinummer)[ \t]*(?:No\.?|Number|#|N°)?" + AFTER + r"(\d{9})"),
    ("SSN", 0.90, PT, "i", r"(?:NIF|Contribuinte|Número\s*(?:de\s*)?(?:contribuinte|fiscal))" + AFTER + r"([12356789]\d{8})"),
    ("SSN", 0.92, IT, "i", r"(?:Codice\s*[Ff]iscale|C\.?F\.?)" + AFTER + r"([A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])"),
    ("SSN", 0.90, DE, "i", r"(?:Steuer-?ID|Steueridentifikationsnummer|Steuernummer|St-?Nr|IdNr)" + AFTER + r"(\d{10,11})"),
    ("SSN", 0.90, DE, "i", r"(?:Sozialversicherungsnummer|SV-?Nummer|SVNR|Versicherungsnummer)" + AFTER + r"(\d{2}\s?\d{6}\s?[A-Z]\s?\d{3})"),
    ("SSN", 0.92, ES, "i", r"(?:DNI|NIE|NIF|Documento\s*(?:Nacional\s*de\s*)?Identidad)[ \t]*(?:No\.?|N[°º])?" + AFTER + r"(\d{8}[A-Z]|[XYZ]\d{7}[A-Z])"),
    ("SSN", 0.90, ES, "i", r"(?:N[°º]?\s*(?:de\s*)?(?:Seguridad\s*Social|SS|Afiliaci[oó]n))" + AFTER + r"(\d{2}[\s/\-]?\d{8,10}[\s/\-]?\d{2})"),
    ("IBAN", 0.90, None, "i", r"(?:IBAN|RIB|Compte\s*bancaire|Bankverbindung|Bank\s*[Aa]ccount|Conto\s*corrente)" + AFTER + r"([A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,8}(?:\s?[A-Z0-9]{1,4})?)"),
    ("CUSTOM", 0.88, None, "i", r"(?:TVA|VAT|Tax\s*ID|N°\s*TVA|Num[ée]ro\s*(?:de\s*)?TVA|USt-IdNr|NIF|SIREN|SIRET|Partita\s*IVA|P\.?IVA)" + AFTER + r"([A-Z]{0,2}[A-Z0-9]{8,14})"),
    ("ADDRESS", 0.80, None, "i", r"(?:Address|Adresse|Anschrift|Direcci[oó]n|Indirizzo|Domicile|Domicilio|Residenza)" + VALUE + r"([^\n\r]{10,80}?)(?=\s*(?:\n|\r|$|(?:Phone|Tel(?:e(?:phone|fon|fax))?|T[ée]l|Mob|Cell|Fax|Facs|Email|Date|Name|Nom|Nome|Cognome)\b))"),
    ("DATE", 0.92, None, "i", r"(?:Date\s*of\s*Birth|DOB|N[ée]\(?e?\)?\s*le|Date\s*de\s*naissance|Geburtsdatum|Geboren\s*am|Fecha\s*de\s*nacimiento|Data\s*di\s*nascita)" + AFTER + r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})"),
    ("DATE", 0.90, None, "i", r"(?:Date\s*of\s*Birth|DOB|N[ée]\(?e?\)?\s*le|Date\s*de\s*naissance)" + AFTER + r"(\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{1,2},?\s+\d{4})"),
    ("PHONE", 0.88, None, "i", r"(?:Phone|Tel(?:e(?:phone|fon|fax))?|T[ée]l(?:[ée]ph(?:one)?)?|T[ée]l[ée]c(?:opieur)?|Telex|Facs(?:imile)?|Telec[óo]p(?:ia)?|Mob(?:ile?)?|Cell|Fax|Port(?:able)?|Fixe|Rufn(?:ummer|r)?|Handy)\.?" + NUMBER + r"([\d \t\+\(\)\.\-]{7,20})"),
    ("EMAIL", 0.95, None, "i", r"(?:Email|E-mail|Courriel|Mail)" + VALUE + r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"),
    ("PERSON", 0.88, None, "i", r"(?:Signed\s*by|Signature\s*of|Executed\s*by|Authorized\s*by|Signé\s*par|Signature\s*de|Unterschrieben\s*von|Unterschrift\s*von|Firmado\s*por|Firma\s*de|Firmato\s*da|Firma\s*di|Ondertekend\s*door|Handtekening\s*van|Assinado\s*por|Assinatura\s*de)" + AFTER + r"([A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,25}(?:[ \t]+(?:de|di|da|van|von|du|del|dos|das)?[ \t]*[A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,25}){1,4})"),
    ("PERSON", 0.88, None, "i", r"(?:Notaire|Notary|Notar(?:in)?|Notaio|Notario|Notaris|Tabelião|Tabeli[ãa]o)" + AFTER + r"((?:M[ae]ître|Ma[iî]tre|Me\.?|Dr\.?|Prof\.?)?\s*" + SIGNER),
    ("PERSON", 0.85, None, "i", r"(?:Witness|Témoin|Zeuge|Zeugin|Testigo|Testimone|Getuige|Testemunha)" + AFTER + "(" + SIGNER),
    ("CUSTOM", 0.92, FR, "i", r"(?:SIREN|N[°º]?\s*SIREN|Numéro\s*SIREN|Numero\s*SIREN)" + AFTER + r"(\d{3}\s?\d{3}\s?\d{3})"),
    ("CUSTOM", 0.92, FR, "i", r"(?:SIRET|N[°º]?\s*SIRET|Numéro\s*SIRET|Numero\s*SIRET)" + AFTER + r"(\d{3}\s?\d{3}\s?\d{3}\s?\d{5})"),
    ("CUSTOM", 0.90, FR, "i", r"(?:RCS|R\.C\.S\.)[ \t]+([A-ZÀ-Ü][a-zà-ü]+\s+\d{3}\s?\d{3}\s?\d{3})"),
    ("CUSTOM", 0.90, DE, "i", r"(?:Handelsregister|HR|Amtsgericht)" + AFTER + r"((?:[A-ZÀ-Ü][a-zà-ü]+\s+)?HR[AB]\s?\d{3,7}(?:\s?[A-Z])?)"),
    ("CUSTOM", 0.90, ES, "i", r"(?:CIF|NIF|C\.I\.F|N\.I\.F)" + AFTER + r"([ABCDEFGHJNPQRSUVW]\d{7}[A-J0-9])"),
    ("CUSTOM", 0.90, IT, "i", r"(?:Partita\s*IVA|P\.?\s*IVA|P\.I\.)" + AFTER + r"(?:IT)?(\d{11})"),
    ("CUSTOM", 0.88, EN, "i", r"(?:Company\s*(?:Number|No\.?|Registration)|Companies\s*House|Registered\s*No\.?)" + AFTER + r"([A-Z]{0,2}\d{6,8})"),
    ("CUSTOM", 0.90, NL, "i", r"(?:KvK|Kamer\s*van\s*Koophandel|KvK-nummer)[ \t]*(?:No\.?|Number|Nr\.?|Nummer)?" + AFTER + r"(\d{8})"),
    ("CUSTOM", 0.92, None, "i", r"(?:BIC|SWIFT|SWIFT\s*Code|BIC\s*Code|Code\s*BIC|Code\s*SWIFT)" + AFTER + r"([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)"),
    ("IBAN", 0.85, EN, "i", r"(?:Sort\s*Code|Routing\s*(?:Number|No\.?)|ABA)" + AFTER + r"(\d{2}-\d{2}-\d{2}|\d{6}|\d{9})"),
    ("IBAN", 0.80, None, "i", r"(?:Account\s*(?:Number|No\.?|#)|Acct\.?\s*(?:No\.?|#)|N[°º]?\s*(?:de\s*)?[Cc]ompte|Kontonummer|Kontonr\.?|N[°º]?\s*(?:de\s*)?[Cc]uenta|Numero\s*[Cc]onto|Rekeningnummer)" + AFTER + r"(\d{6,17})"),
    ("PERSON", 0.90, None, "i", r"(?:Physician|Doctor|Attending|Treating|Referring|M[ée]decin(?:\s*traitant)?|Praticien|Arzt|[ÄA]rztin|Behandelnder\s*Arzt|M[ée]dico|Dottore|Dott\.?(?:ssa)?|Arts|Behandelend\s*arts)" + AFTER + r"((?:Dr\.?|Prof\.?|Dott\.?(?:ssa)?)\s*" + SIGNER),
    ("ORG", 0.85, None, "i", r"(?:Hospital|Clinic|Medical\s*Center|Health\s*(?:Centre|Center)|H[ôo]pital|Clinique|Centre\s*(?:hospitalier|m[ée]dical)|CHU|Krankenhaus|Klinik|Universit[äa]tsklinikum|Ospedale|Clinica|Policlinico|Ziekenhuis|Kliniek|Hospital|Cl[ií]nica|Centro\s*(?:Hospitalar|M[ée]dico))" + AFTER + r"((?:[A-ZÀ-Ü][a-zA-Zà-ü'\-]+\s*){1,6})"),
    ("CUSTOM", 0.90, None, "i", r"(?:Medical\s*Record\s*(?:Number|No\.?|#)|MRN|Patient\s*(?:ID|Number|No\.?|#)|Dossier\s*(?:m[ée]dical)?(?:\s*n[°º]?)?|N[°º]?\s*(?:de\s*)?dossier(?:\s*m[ée]dical)?|Patientenakte|Patientennummer|Cartella\s*clinica|N[°º]?\s*cartella|Historial(?:\s*cl[ií]nico)?|Pati[ëe]ntnummer|Dossiernummer|Prontu[áa]rio|Processo\s*cl[ií]nico)" + AFTER + r"([A-Z0-9][\w\-]{3,15})"),
    ("CUSTOM", 0.88, None, "i", r"(?:Health\s*Insurance|Insurance\s*(?:Number|No\.?|ID|Policy)|(?:Carte\s*)?[Vv]itale|Assurance\s*[Mm]aladie|N[°º]?\s*(?:d[e']\s*)?Assur[ée](?:\s*social)?|Krankenversichertennummer|Versichertennummer|Kassennummer|Krankenkasse(?:nnummer)?|Tessera\s*[Ss]anitaria|N[°º]?\s*tessera|Tarjeta\s*[Ss]anitaria|N[°º]?\s*(?:de\s*)?afiliaci[oó]n|Zorgverzekering(?:snummer)?|Polisnummer|UZOVI|N[°º]?\s*(?:de\s*)?[Uu]tente|Cart[ãa]o\s*(?:de\s*)?[Ss]a[úu]de)" + AFTER + r"([A-Z0-9][\w\s\-]{5,25})"),
    ("SSN", 0.92, EN, "i", r"(?:NHS\s*(?:Number|No\.?|#)|NHS\s*ID)" + AFTER + r"(\d{3}\s?\d{3}\s?\d{4})"),
    ("SSN", 0.92, DE, "i", r"(?:Krankenversichertennummer|Versichertennummer|KVNR|Versicherten-Nr)" + AFTER + r"([A-Z]\d{9})"),
    ("SSN", 0.88, IT, "i", r"(?:Tessera\s*[Ss]anitaria|N\.?\s*Tessera|Cod(?:ice)?\s*Sanitario)" + AFTER + r"(\d{20}|[A-Z0-9]{10,20})"),
    ("PERSON", 0.85, None, "i", r"(?:Emergency\s*Contact|Next\s*of\s*Kin|In\s*Case\s*of\s*Emergency|\bICE\b|Personne\s*[àa]\s*(?:contacter|pr[ée]venir)|Contact\s*d['\u2019]urgence|Notfallkontakt|Kontaktperson|Contacto\s*de\s*emergencia|Contatto\s*(?:di\s*)?emergenza|Noodcontact|Contactpersoon|Contacto\s*de\s*emerg[êe]ncia|Pessoa\s*de\s*contacto)" + AFTER + "(" + SIGNER),
    ("SSN", 0.90, PT, "i", r"(?:NISS|N[°º]?\s*(?:de\s*)?Segurança\s*Social|Seguran[çc]a\s*Social(?:\s*n[°º]?)?)" + AFTER + r"(\d{11})"),
    ("SSN", 0.90, PT, "i", r"(?:CPF|Cadastro\s*(?:de\s*)?Pessoa\s*F[ií]sica)" + AFTER + r"(\d{3}\.?\d{3}\.?\d{3}-?\d{2})"),
    ("CUSTOM", 0.90, PT, "i", r"(?:CNPJ|Cadastro\s*(?:Nacional\s*(?:de\s*)?)?Pessoa\s*Jur[ií]dica)" + AFTER + r"(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})"),
    ("CUSTOM", 0.85, None, "i", r"(?:Policy\s*(?:Number|No\.?|#)|Police\s*(?:d['\u2019]assurance\s*)?(?:n[°º]?)?|Policennummer|Polizza|P[oó]liza|Polisnummer|Ap[oó]lice)" + AFTER + r"([A-Z0-9][\w\-]{5,20})"),
    ("PERSON", 0.85, None, "i", r"(?:Beneficiary|Payee|Pay\s*to(?:\s*the\s*order\s*of)?|B[ée]n[ée]ficiaire|Ordre\s*de|Beg[üu]nstigter|Zahlungsempf[äa]nger|Beneficiario|Destinatario|Begunstigde|Benefici[áa]rio)" + AFTER + r"([A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,25}(?:[ \t]+[A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,25}){1,4})"),
    ("PERSON", 0.85, None, "i", r"(?:Guarantor|Surety|Co-signer|Garant|Caution(?:naire)?|B[üu]rge|Garante|Fideiussore|Fidejussore|Borg|Fiador|Avalista)" + AFTER + "(" + SIGNER),
    ("PERSON", 0.88, None, "i", r"(?:Power\s*of\s*Attorney|Attorney-in-Fact|Legal\s*Representative|Mandataire|Repr[ée]sentant(?:\s*l[ée]gal)?|Fond[ée]\s*de\s*pouvoir|Bevollm[äa]chtigter|Rechtsvertreter|Vertretungsberechtigt|Procuratore|Rappresentante\s*legale|Apoderado|Representante\s*legal|Gevolmachtigde|Vertegenwoordiger|Procurador|Mandatário|Mandat[áa]rio)" + AFTER + r"([A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,25}(?:[ \t]+[A-ZÀ-Ü][a-zA-Zà-ü'\-]{1,25}){1,4})"),
]

#: A match that lies wholly inside the first hit of one of these, in a window around it, is dropped.
EXCLUDED = [
    ("i", r"\bpage\s+\d+"),
    ("i", r"\bp\.\s*\d+"),
    ("i", r"\b(?:section|sec|figure|fig|table|tab|chapter|ch|item|no|#|art(?:icle)?)\s*\.?\s*\d+"),
    ("i", r"\bv(?:ersion)?\s*\d+(?:\.\d+)+"),
    ("", r"\b\d+(?:\.\d+)?%"),
    ("", r"[$€£¥]\s*\d"),
    ("", r"\b\d[\d,]*\.\d{2}\b"),
    ("", r"\[\d{1,3}\]"),
    ("i", r"\b\d+(?:\.\d+)?\s*(?:KB|MB|GB|TB)\b"),
    ("i", r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?\b"),
    ("i", r"\b(?:INV|PO|SO|REF|REQ|TKT|DOC|ID)[-#]?\d+\b"),
    ("i", r"\b(?:note|annexe?|schedule|exhibit)\s+\d+"),
    ("i", r"\b(?:FY|fiscal\s+year|exercice|année|annee)\s*\d{4}\b"),
    ("i", r"\b(?:compte|account|code)\s+\d{3,6}\b"),
]
