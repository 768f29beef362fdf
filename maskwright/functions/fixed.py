"""Tables, word lists, patterns and formats that results depend on."""

# Verhoeff: dihedral group, permutations, inverses.
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6], [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1], [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2], [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 0, 7, 6, 8], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1], [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]
VERHOEFF_INV = [0, 4, 3, 2, 1, 5, 6, 7, 8, 9]

# White space of the web platform, as a character class.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_SPACE = r"[^\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# A border of ASCII words.
BORDER = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Pattern detectors in order of priority.
DETECTORS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "CARD": r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])",
    "AADHAAR": r"(?<![0-9])[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])",
    "PAN": WORD_START + r"[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]" + WORD_END,
    "IFSC": WORD_START + r"[A-Z]{4}0[A-Z0-9]{6}" + WORD_END,
    "UPI": BORDER + r"[A-Za-z0-9._-]{2,64}@[A-Za-z]{2,32}(?![A-Za-z0-9_.@])",
    "PHONE": r"(?<![0-9+])(?:\+?91[ -]?|0)?[6-9][0-9]{4}[ -]?[0-9]{5}(?![0-9])",
}
# The guard of the receiving side reads digits and words of all scripts.
GUARD_DETECTORS = {
    "EMAIL": DETECTORS["EMAIL"],
    "CARD": r"(?U)(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)",
    "AADHAAR": r"(?U)(?<!\d)[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?!\d)",
    "PAN": r"(?U)(?<!\w)[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z](?!\w)",
    "IFSC": r"(?U)(?<!\w)[A-Z]{4}0[A-Z0-9]{6}(?!\w)",
    "UPI": r"(?U)(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))[A-Za-z0-9._-]{2,64}@[A-Za-z]{2,32}(?![\w.@])",
    "PHONE": r"(?U)(?<![\d+])(?:\+?91[ -]?|0)?[6-9]\d{4}[ -]?\d{5}(?!\d)",
}

# Classes, and their groups.
GROUPS = {
    "SECRET": "SECRET", "AADHAAR": "GOV_ID", "PAN": "GOV_ID", "PASSPORT": "GOV_ID", "VOTER_ID": "GOV_ID",
    "CARD": "FINANCIAL", "ACCOUNT": "FINANCIAL", "IFSC": "FINANCIAL", "UPI": "FINANCIAL",
    "EMAIL": "CONTACT", "PHONE": "CONTACT", "ADDRESS": "CONTACT", "USERNAME": "CONTACT",
    "NAME": "PERSON", "DOB": "PERSON", "FACE": "BIOMETRIC", "SIGNATURE": "BIOMETRIC", "QR": "ENCODED", "IMAGE": "RASTER", "CUSTOM": "CUSTOM",
}
ROLES = ["textbox", "password", "checkbox", "radio", "combobox", "button", "link", "image", "other"]
FIELD_ROLES = ["textbox", "password", "combobox"]
MARK_ROLES = ["textbox", "password", "combobox", "checkbox", "radio", "button", "link"]
NO_VALUE = ["SECRET", "FACE", "SIGNATURE", "QR", "IMAGE"]
DICTIONARY_CLASSES = ["NAME", "EMAIL", "ADDRESS", "USERNAME", "DOB", "UPI", "CUSTOM"]
DIGIT_CLASSES = ["AADHAAR", "CARD", "ACCOUNT"]
UPPER_CLASSES = ["PAN", "IFSC", "PASSPORT", "VOTER_ID"]
LOWER_CLASSES = ["EMAIL", "UPI", "USERNAME"]
SHAPE_CLASSES = ["AADHAAR", "PAN", "PHONE", "IFSC", "CARD", "DOB", "PASSPORT", "VOTER_ID", "ACCOUNT"]

# Class of a field by its label, in order; \b is a border of ASCII words.
CONTEXT_RULES = [
    (r"\b(pass ?word|passcode|passphrase)\b", "SECRET"),
    (r"\b(otp|one[- ]time)\b", "SECRET"),
    (r"\b(cvv|cvc|csc|security code)\b", "SECRET"),
    (r"\b(pin ?code|postal|zip|address|street|locality|landmark)\b", "ADDRESS"),
    (r"\b(m?pin|upi pin|atm pin)\b", "SECRET"),
    (r"\b(aadhaa?r|aadhar|uidai|uid)\b", "AADHAAR"),
    (r"\bpan\b|permanent account", "PAN"),
    (r"\bpassport\b", "PASSPORT"),
    (r"\b(voter|epic)\b", "VOTER_ID"),
    (r"\b(card number|card no|credit card|debit card|cc-number|expiry|expiration|exp date|valid thru|valid till)\b", "CARD"),
    (r"\b(account (no|number|#)|a/c|acct)\b", "ACCOUNT"),
    (r"\bifsc\b", "IFSC"),
    (r"\b(upi|vpa)\b", "UPI"),
    (r"\b(e-?mail)\b", "EMAIL"),
    (r"\b(phone|mobile|contact number|tel|whatsapp)\b", "PHONE"),
    (r"\b(user ?name|user id|login id)\b", "USERNAME"),
    (r"\b(dob|d\.o\.b|date of birth|birth ?date|born)\b", "DOB"),
    (r"\b(full name|first name|last name|middle name|surname|given name|family name|father'?s name|mother'?s name|spouse|nominee|holder|applicant|name)\b", "NAME"),
]
# Class of a field by its autocomplete attribute, in order.
AUTOCOMPLETE_RULES = [
    (r"(current|new)-password", "SECRET"),
    (r"one-time-code", "SECRET"),
    (r"cc-csc", "SECRET"),
    (r"cc-(number|exp)", "CARD"),
    (r"\b(name|given-name|family-name|additional-name|cc-name)\b", "NAME"),
    (r"\bemail\b", "EMAIL"),
    (r"\btel", "PHONE"),
    (r"\bbday", "DOB"),
    (r"(street-address|address-line|postal-code|address-level)", "ADDRESS"),
    (r"\busername\b", "USERNAME"),
]
# `Label: value` in running text: what comes before, label, value.
LABEL_VALUE = (
    rf"(^|[.;|,]{SPACE}+|{SPACE}{{2,}})([A-Za-z][A-Za-z .'/()#]{{1,40}}?){SPACE}*[:：]{SPACE}+(.+?)"
    rf"(?={SPACE}*(?:[.;|](?:{SPACE}|\z)|{SPACE}{{2,}}|\z|,?{SPACE}+[A-Z][A-Za-z ]{{1,30}}[:：]))"
)
TOKEN = r"⟦([A-Z_]+?)_([0-9]+)⟧"
LATE_TOKEN = r"⟦[A-Z_]+_[0-9]+⟧"

# Images that say what they show.
IMAGE_HINTS = [(r"(?i)\b(qr|bar ?code)\b", "QR"), (r"(?i)\b(photo of|portrait|selfie|avatar|profile (photo|picture|pic)|face)\b", "FACE")]
# Labels whose click can't be undone: on the acting side, and on the planning side.
CLIENT_IRREVERSIBLE = r"(?i)\b(submit|pay|payment|confirm|place order|send|delete|remove|transfer|finish|apply now|sign)\b"
SERVER_IRREVERSIBLE = r"(?i)\b(submit|pay|confirm|place order|send|delete|transfer|finish|apply)\b"
PRIMARY = r"(?i)\b(continue|next|proceed|submit|save|verify|register|create account|apply|sign up|finish)\b"
COMPATIBLE = {"USERNAME": ["EMAIL", "PHONE"], "ACCOUNT": ["CARD"]}

# Path segments that name a thing.
ID_SEGMENTS = [r"^[0-9]+\z", r"(?i)^[0-9a-f]{8,}\z", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z", r"@"]
LONGEST_SEGMENT = 32
LOCAL_HOSTS = ["localhost", "127.0.0.1", "[::1]"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}

# Mask widths in heights, by class.
MASK_FIXED_CLASSES = ["AADHAAR", "PAN", "PASSPORT", "VOTER_ID", "CARD", "ACCOUNT", "IFSC", "PHONE", "DOB"]
MASK_REGIONS = ["FACE", "SIGNATURE", "QR", "IMAGE"]
MASK_SECRET, MASK_FIXED, MASK_VARIABLE = [6.0], [6.0, 8.0, 11.0], [3.0, 4.0, 5.5, 7.5, 10.0, 14.0, 19.0, 26.0, 35.0]
MASK_PAD = 3

# Limits.
MAX_TEXTS, MAX_TEXT_CHARS, MAX_BLOCKS, MAX_OPTIONS, MAX_RASTERS, MAX_SIGNATURE, MAX_MISSING, MAX_HISTORY = 150, 300, 400, 30, 6, 40, 4, 8
MAX_STEPS_CLIENT, MAX_STEPS_SERVER, MAX_BODY, TTL_SECONDS, NER_BUDGET = 12, 25, 2 * 1024 * 1024, 15 * 60, 8000
VERSION = "1.0"
