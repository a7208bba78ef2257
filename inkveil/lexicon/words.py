"""Words that raise or lower confidence, and stop words for language detection."""

from __future__ import annotations

# Keyword lists per type, phone labels, country codes, words like bank codes, stop words.

CONTEXT = {
    "SSN": [
        "ssn", "social security", "social sec", "tax id", "tin", "sécurité sociale", "securite sociale", "sécu", "secu", "nir", "n° ss", "n°ss",
        "numéro ss", "numero ss", "steuer-id", "steueridentifikationsnummer", "steuernummer", "nif", "dni", "nie", "codice fiscale", "fiscal",
        "rijksregisternummer", "bsn", "burgerservicenummer", "national insurance", "ni number", "nino", "contribuinte", "número de contribuinte",
        "tessera sanitaria", "nhs", "nhs number", "nhs no", "ein", "employer id", "employer identification", "fein", "krankenversichertennummer",
        "versichertennummer", "kvnr", "versicherten-nr", "krankenkasse", "patient id", "patient number", "medical record", "mrn", "numéro de patient",
        "patientennummer", "patientenakte", "niss", "segurança social", "seguridad social", "tarjeta sanitaria", "afiliación", "cpf", "cadastro",
    ],
    "PHONE": [
        "phone", "tel", "téléphone", "telephone", "mobile", "cell", "fax", "call", "contact", "number", "numéro", "numero", "portable", "fixe", "desk",
        "direct", "ligne", "rufnummer", "telefon", "handy", "mobil", "teléfono", "telefono", "cellulare", "celular", "télécopieur", "telecopieur", "téléc",
        "telec", "telex", "telefax", "facsimile", "facs", "telecópia", "telecopia", "téléph", "teleph", "mob", "port", "rufnr", "telecop", "telecóp",
    ],
    "EMAIL": [
        "email", "e-mail", "mail", "courriel", "courrier", "electronic", "électronique", "electronique",
    ],
    "CREDIT_CARD": [
        "card", "credit", "debit", "visa", "mastercard", "amex", "payment", "account", "carte", "bancaire", "cb", "paiement", "kreditkarte", "tarjeta",
        "carta",
    ],
    "IBAN": [
        "iban", "bank", "account", "swift", "bic", "compte", "bancaire", "banque", "rib", "kontonummer", "bankverbindung", "konto", "cuenta", "conto",
        "rekening", "sort code", "routing", "aba", "transit", "account number", "acct", "numéro de compte", "rekeningnummer", "número de cuenta",
        "numero conto",
    ],
    "DATE": [
        "born", "birth", "dob", "date of birth", "expires", "expiry", "issued", "valid", "deceased", "hired", "terminated", "né le", "nee le", "née le",
        "date de naissance", "geburtsdatum", "geboren", "nacimiento", "nato il", "nata il", "data di nascita", "dated", "as of", "effective", "signed",
        "executed", "filed", "registered", "incorporated", "established", "fiscal year", "period ended", "quarter ended", "ending", "closing date",
        "year end", "en date du", "exercice", "période", "periode", "clos le", "terminé le", "termine le", "signé le", "signe le", "fait le", "établi le",
        "etabli le", "pour la période", "bilan au", "arrêté le", "arrete le", "comptes au", "clôture", "cloture", "daté du", "datée du", "date du",
        "datum", "stichtag", "zum", "geschäftsjahr", "abschlussdatum", "unterzeichnet am", "alla data del", "esercizio chiuso", "firmato il",
        "bilancio al", "fecha", "ejercicio cerrado", "firmado el", "balance al",
    ],
    "PERSON": [
        "name", "patient", "client", "applicant", "employee", "mr", "mrs", "ms", "dr", "prof", "sir", "madam", "first name", "last name", "full name",
        "surname", "given name", "maiden name", "alias", "known as", "nom", "prénom", "prenom", "employé", "employe", "salarié", "salarie", "monsieur",
        "madame", "mademoiselle", "nom de famille", "nom complet", "identité", "identite", "vorname", "nachname", "familienname", "herr", "frau", "nombre",
        "apellido", "cognome", "nome", "señor", "señora", "signor", "signora", "signed by", "signature", "witness", "notary", "party", "signé par",
        "notaire", "témoin", "partie", "unterschrieben", "notar", "zeuge", "partei", "firmado", "testigo", "parte", "firmato", "testimone", "ondertekend",
        "getuige", "physician", "doctor", "attending", "treating", "médecin", "praticien", "arzt", "ärztin", "medico", "dottore", "arts", "beneficiary",
        "payee", "guarantor", "representative", "bénéficiaire", "garant", "mandataire", "begünstigter", "bürge",
    ],
    "ADDRESS": [
        "address", "street", "city", "state", "zip", "postal", "residence", "home", "mailing", "domicile", "located at", "lives at", "residing", "adresse",
        "rue", "avenue", "boulevard", "ville", "code postal", "cedex", "lieu-dit", "habite", "anschrift", "straße", "strasse", "plz", "wohnort",
        "dirección", "direccion", "calle", "indirizzo", "via", "piazza", "corso", "viale", "cap", "domicilio", "residenza",
    ],
    "LOCATION": [
        "city", "town", "country", "state", "province", "region", "county", "municipality", "district", "born in", "located in", "based in", "from",
        "origin", "nationality", "citizen", "ville", "pays", "commune", "département", "departement", "région", "né à", "née à", "originaire",
        "nationalité", "nationalite", "domicilié", "domiciliée", "stadt", "land", "gemeinde", "kreis", "bundesland", "geboren in", "staatsangehörigkeit",
        "ciudad", "país", "pais", "provincia", "comune", "nazione", "cittadinanza", "nacionalidad", "regione", "città", "nato a", "nata a", "residente",
    ],
    "PASSPORT": [
        "passport", "passeport", "reisepass", "pasaporte", "passaporto", "travel document", "document de voyage",
    ],
    "DRIVER_LICENSE": [
        "driver", "license", "licence", "dl", "driving", "permis", "conduire", "führerschein", "fuhrerschein", "patente", "licencia", "rijbewijs",
        "patente di guida", "carta di circolazione",
    ],
    "IP_ADDRESS": [
        "ip", "address", "server", "host", "endpoint",
    ],
    "CUSTOM": [
        "badge", "employee id", "emp id", "staff id", "member id", "case", "file", "dossier", "numéro dossier", "n° dossier", "reference", "référence",
        "matricule", "registration", "vat", "tva", "tax", "ust-idnr", "ust", "siren", "siret", "rcs", "handelsregister", "hrb", "hra", "amtsgericht",
        "registro mercantil", "cif", "kvk", "kamer van koophandel", "companies house", "partita iva", "p.iva", "cnpj", "bic", "swift", "swift code",
        "bic code", "policy", "police", "polizza", "póliza", "apolice", "policennummer", "polisnummer", "medical record", "mrn", "patient id",
        "dossier médical", "patientenakte", "cartella clinica", "historial", "prontuário", "prontuario", "health insurance", "assurance maladie",
        "krankenkasse", "tessera sanitaria", "tarjeta sanitaria", "zorgverzekering",
    ],
}

PHONE_LABELS = [
    "phone", "tel", "tél", "téléphone", "telephone", "mobile", "mob", "cell", "cellulare", "celular", "fax", "portable", "port", "fixe", "rufnummer",
    "rufnr", "telefon", "handy", "mobil", "teléfono", "telefono", "télécopieur", "telecopieur", "téléc", "telec", "telex", "telefax", "facsimile", "facs",
    "telecópia", "telecopia", "téléph", "teleph", "telecóp", "telecop", "telefoon", "telefone",
]

BIC_COUNTRIES = "AD AE AT AU BE BG BH BR CA CH CL CN CO CY CZ DE DK EE EG ES FI FR GB GR HK HR HU ID IE IL IN IS IT JP KR KW LB LI LT LU LV MA MC MT MX MY NL NO NZ PE PH PL PT QA RO RS RU SA SE SG SI SK TH TR TW UA US UY VN ZA".split()

BIC_WORDS = frozenset("ABSTRACT ACHIEVED APPROACH ATTACHED BENEDEIT BENEFITS BRIGHTLY CHAPTERS CLOSURES COHERENT COMBINED CONCLUDE CONFLICT CONNECTS CONSIDER CONTENTS CONTRACT CONTROLS CREATION CREDITED CULTURES CUSTOMER DECEMBER DEFEATED DEPICTED DETAILED DISTINCT DOCTRINE DOCUMENT DOMESTIC DESCRIPT ELECTION ENTITLED ESTIMATE EVALUATE EVENTUAL EXPLORED FINISHED FORMERLY FRACTION FUNCTION GATHERED GENERATE GRATEFUL GRAPHICS GREATEST GUIDANCE HAPPENED HISTORIC INCIDENT INCLUDES INCREASE INDUSTRY INFINITE INFORMED INHERITS INITIATE INSPIRED INSTANCE INTEGRAL INTERACT INTEREST INTERNAL MULTIPLE NATIONAL NOTIFIED OBTAINED OCCURRED OFFICIAL OPERATED OPTIONAL OUTLINED OVERHEAD PARALLEL PATIENTS PERFORMS PERIODIC PETITION PLATFORM PLEASURE POLITICS POSITIVE POSSIBLE PRACTICE PRECIOUS PRESENCE PRESERVE PREVIOUS PRINCESS PRIORITY PROBABLE PRODUCED PRODUCTS PROMOTED PROPERLY PROPOSAL PROPOSED PROSPECT PROTOCOL PROVIDED PROVIDER PROVINCE PURCHASE REACTION RECEIVED RECENTLY RECORDED REFLECTS REGIONAL REGISTER REJECTED RELATION RELEASED REMAINED REMEMBER REPEATED REPLACED REPORTED REQUIRED RESEARCH RESERVED RESOLVED RESOURCE RESPONSE RESULTED RETAINED RETURNED REVIEWED REVISION SEARCHED SECTIONS SELECTED SENTENCE SEQUENCE SETTINGS SITUATED SOLUTION SPECIFIC STANDARD STRATEGY STRENGTH STRONGLY SUBJECTS SUPPLIED SUPPORTS SUPPOSED TOGETHER TRANSFER TREASURE UNLISTED UPLOADED UTILISED UTILIZES VERIFIED VETERANS VIOLATED INTENDED".split())

#: In the order in which ties between languages are decided.
STOP_WORDS = {
    "en": "the be to of and a in that have i it for not on with he as you do at this but his by from they we her she or an will my one all would there their what so if about who which when can no just him know into your some could them than then its over also after how our well even because any these us out was were been being had has did are is am",
    "es": "de la que el en y a los del se las por un para con no una su al lo como pero sus le ya o este entre cuando muy sin sobre me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto antes algunos unos yo otro otras otra tanto esa estos esta fue son tiene ser han era",
    "fr": "de la le et les des en un du une que est dans qui par pour au il sur ne se pas plus son ce avec ou mais sont sa aux ont ses cette comme nous tout aussi elle fait ces entre dont leur bien peut tous sans je lui donc encore avant depuis nos deux fois avait",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem so zum aber ihr nur oder mir war mich gegen vom wenn durch dann unter sehr selbst schon hier bis alle diese mehr da wo kann haben sein",
    "it": "di che la il un a per in una mi ma lo ha le si ho non con li da se no come io ci questo dei nel del al sono era gli suo anche alla tutto della fatto dal stata ancora dopo essere quella fare qui dove sua stato loro questa tra hai poi abbiamo",
    "nl": "de het een van en in is dat op te zijn voor met die niet er aan ook als maar om bij dan nog naar heeft ze uit kan dit was worden al wel over door tot veel meer had haar wat zou hun geen werd wij heb moet ons dag twee zo alle hij",
    "pt": "de a o que e do da em um para com uma os no se na por mais as dos como mas foi ao ele das tem seu sua ou ser quando muito nos já eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles está você tinha foram essa num nem suas meu minha numa pelos",
}

#: Stripped from both ends of a word before it is looked up.
WORD_EDGES = ".,;:!?()[]{}\"'«»—–-"

#: Letters of the tokens that stand for a value of each type.
TOKEN_LETTERS = {"PERSON": "P", "ORG": "O", "EMAIL": "E", "PHONE": "T", "SSN": "S", "CREDIT_CARD": "C", "DATE": "D", "ADDRESS": "A", "LOCATION": "L", "IP_ADDRESS": "I", "IBAN": "B", "PASSPORT": "X", "DRIVER_LICENSE": "R", "CUSTOM": "K", "UNKNOWN": "U"}
