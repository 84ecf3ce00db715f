"""Word lists. Each predicate tries its list in order and quotes the first pattern that matches."""

from __future__ import annotations

# Word lists as regular expressions, in the order in which they are tried.
RECURRING = [
    r"\bauto[\s-]?renew(s|al|ing)?\b", r"\brecurring\b", r"\bsubscription\b", r"\bsubscribe\b", r"\bper\s+(month|year|week)\b",
    r"/\s*(mo|month|yr|year|week)\b", r"\bmonthly\b", r"\byearly\b", r"\bannually\b", r"\bbilled\s+(monthly|annually|yearly)\b",
    r"\bfree trial\b", r"\btrial (then|converts)\b", r"\bthen\s*[₹$]\s?[\d,]+",
]
UNRELATED_CONSENT = [
    r"\bmarketing\b", r"\bpromotions?\b", r"\bpromotional\b", r"\bnewsletter\b", r"\boffers? and updates?\b", r"\bthird[\s-]?part(y|ies)\b",
    r"\bpartners?\b", r"\bshare (my|your) (data|details|information)\b", r"\brefer a friend\b", r"\binvite (your )?(friends?|contacts?)\b",
    r"\baccess (to )?(your )?contacts?\b", r"\bfollow us\b", r"\bsms\b.*\boffers?\b", r"\bwhatsapp\b.*\b(offers?|updates?)\b",
    r"\bpersonalised? ads?\b", r"\btargeted ads?\b",
]
LAWFUL_CONTEXT = [
    r"\bprivacy (policy|notice)\b", r"\bterms (and conditions|of (service|use))\b", r"\bi have read\b", r"\backnowledge\b",
    r"\bdeliver(y|ies)\b.*\bpartners?\b", r"\bpartners?\b.*\bdeliver(y|ies)\b", r"\bcourier\b", r"\bshipment\b",
    r"\bfulfil(l)?ment\b", r"\brequired by law\b", r"\bgrievance\b",
]
SYSTEM_ALERT = [
    r"\bvirus (detected|found)\b", r"\byour (device|system|pc|phone|computer) is (infected|at risk)\b", r"\bmalware detected\b",
    r"\bsecurity (alert|warning|threat)\b", r"\bsystem (alert|warning|error)\b", r"\bcritical (alert|warning|error)\b",
    r"\byour (device|system|pc|phone|computer) (may be|is) (infected|compromised)\b", r"\b\d+ (viruses|threats|problems) (found|detected)\b",
    r"\bimmediate action required\b", r"\bwindows (defender|security)\b", r"\byour (flash player|browser) is out of date\b",
]
INSTALL_CTA = [r"\bdownload now\b", r"\binstall now\b", r"\bscan now\b", r"\bclean now\b", r"\bfix now\b", r"\brepair now\b", r"\bupdate now\b", r"\bprotect now\b", r"\benable now\b"]
CANCEL_ROUTE = [
    r"\bcancel (my )?(subscription|plan|membership|trial)\b", r"\bmanage (my )?(subscription|plan|membership|billing)\b",
    r"\bunsubscribe\b", r"\bend (my )?(subscription|membership|trial)\b", r"\bturn off auto[\s-]?renew\b",
]
OVERLAY_DEMAND = [
    r"\bsign\s?up\b", r"\bcreate (an )?account\b", r"\bregister\b", r"\blog ?in\b", r"\bsubscribe\b", r"\benter your\b", r"\byour email\b",
    r"\bemail address\b", r"\bphone number\b", r"\bagree\b", r"\baccept\b", r"\ballow\b", r"\bconsent\b", r"\bcontinue to\b", r"\bverify\b",
    r"\bcomplete your\b", r"\bunlock\b", r"\bto continue\b", r"\bmust\b", r"\brequired\b",
]
NON_COMMITMENT = [
    r"\bnewsletter\b", r"\bmailing list\b", r"\bemail(s)? updates?\b", r"\bsubscribe (to|for) (our |the )?(newsletter|updates?|emails?|blog|deals?|alerts?)\b",
    r"\bstay (updated|informed|in the loop)\b", r"\bget (our )?updates?\b", r"\bnotify me\b", r"\balerts?\b",
]
COMMITMENT_CTA = [
    r"\bstart (my )?(free )?trial\b", r"\bsubscribe\b", r"\bstart (my )?membership\b", r"\bget (started|premium|plus|pro)\b", r"\bupgrade\b", r"\bjoin now\b",
]
RECURRING_PRICE = [
    r"(?:₹|Rs\.?|INR|US\$|\$|€|£|¥)\s*[\d,]+(?:\.\d{1,2})?\s*(?:/|per\s+|a\s+|each\s+)?\s*(?:mo\b|month|yr\b|year|week|annually)"
    r"|\b(?:billed|renews?|charged)\s+(?:monthly|annually|yearly|weekly)\b",
]
GUILT = [
    r"\bi don'?t (like|want|need|care about|mind|hate|despise)\b", r"\bi'?d?\s*(rather|prefer)\s*(to\s*)?(not\s+)?(pay|have|save|win)\b",
    r"\bi don'?t feel lucky\b", r"\bi want to pay (more|the full price)\b", r"\bi do not want\b", r"\baccept (all )?(the )?risk\b",
    r"\bwithout (a )?(protection|insurance|discount)\b", r"\bi'?ll (risk|let this offer|be the last)\b", r"pay(ing)?\s*full price",
    r"like (paying )?full price", r"don'?t (mind )?miss(ing)? out", r"don'?t want \d+%", r"'?d like \d+% off", r"not interested\b",
    r"\bhate (saving|cool)\b", r"i'?ve got too much\b",
]
DOUBLE_NEGATIVE = [
    r"\bunche?ck\b[^.]{0,60}\b(if|to)\b[^.]{0,40}\b(not|don'?t|do not|no longer|never)\b", r"\buntick\b[^.]{0,60}\b(if|to)\b[^.]{0,40}\b(not|don'?t|do not)\b",
    r"\b(do not|don'?t)\b[^.]{0,40}\b(unche?ck|untick|opt out)\b", r"\b(not|never)\b[^.]{0,30}\bdisagree\b",
    r"\bopt out\b[^.]{0,40}\b(not|stop|prevent)\b[^.]{0,40}\breceiv", r"\bdisagree\b[^.]{0,30}\b(not|never)\b",
    r"\bdecline\b[^.]{0,30}\bnot\b[^.]{0,30}\b(receive|participate)\b",
]
OPT_OUT = [r"\bdo not\b", r"\bdon'?t\b", r"\bopt out\b", r"\bunsubscribe\b", r"\bno longer\b", r"\bstop (sending|receiving)\b", r"\bexclude me\b"]
URGENCY = [
    r"only\s+\d+\s+(left|remaining|seats?|units?|at this price)", r"hurry", r"offer ends?", r"limited time", r"\d+\s+people (are\s+)?(viewing|booked|bought|seeing)",
    r"selling fast", r"sell(ing)? out (fast|quickly)", r"\bwill sell out\b", r"high[\s-]?demand", r"strong demand", r"in high demand", r"\d+\s+claimed", r"claimed!",
    r"expect \d.*(weeks|days).*arrive", r"low(\s+in)? stock", r"limited stock", r"reserved for \d+", r"sale ends? (once|when)", r"few (left|remaining)",
    r"\d+[^.\n]{0,20}(left|in stock|remaining)",
]
DISMISS = [
    r"^\s*[x✕✖×]\s*$", r"\bclose\b", r"\bdismiss\b", r"\bnot now\b", r"\bno thanks?\b", r"\bmaybe later\b", r"\blater\b", r"\bskip\b",
    r"\bcancel\b", r"\bcontinue without\b", r"\bdecline\b", r"\bno,? ",
]
DEADLINE_WORDS = ["offer ends", "sale ends", "limited time", "ends in", "expires", "deal ends", "hurry"]
NEVER_CLICK = [
    r"\bpay\b", r"\bpay now\b", r"\bmake payment\b", r"\bconfirm (and )?pay\b", r"\bplace (the )?order\b", r"\bconfirm order\b",
    r"\bcomplete (the )?(order|purchase)\b", r"\bbuy now\b", r"\bsubscribe\b", r"\bstart (my )?(free )?trial\b", r"\bupgrade\b", r"\bdonate\b",
    r"\bpre-?order\b", r"\bbid\b", r"\bdelete\b", r"\bremove\b", r"\bcancel my\b", r"\bsign (in|up)\b", r"\blog ?in\b", r"\bregister\b",
]
STAGES = [
    ("product", [r"\bview (product|details|item)\b", r"\bshop now\b", r"\bsee details\b", r"\bview more\b", r"\bproduct details\b", r"\bmore details\b", r"\bquick view\b", r"\bselect options\b", r"\bview item\b"]),
    ("cart", [
        r"\badd to (cart|bag|basket|trolley|tote)\b", r"\badd item\b", r"\badd to my (cart|bag|basket)\b", r"\badd\b(?=.*\bcart\b)", r"\bview (cart|bag|basket)\b",
        r"\bgo to (cart|bag|basket)\b", r"\bmy (cart|bag|basket)\b", r"\bopen (cart|bag|basket)\b", r"\bshopping (cart|bag|basket)\b",
    ]),
    ("checkout", [r"\b(proceed to )?check\s?out\b", r"\bcontinue to (checkout|payment|delivery|shipping)\b", r"\bgo to checkout\b", r"\bsecure checkout\b", r"\bcheckout now\b", r"\bproceed\b", r"\bcontinue\b"]),
    ("order_summary", [r"\bcontinue to (payment|summary|review)\b", r"\breview (your )?order\b", r"\border summary\b", r"\bnext\b"]),
]
# Expressions for totals, promises, money, clocks and programs.
TOTAL = r"\b(total|subtotal|sub-total|amount payable|grand total|order total|you pay|payable|order summary|amount to pay)\b"
PROMO = r"free\s+(shipping|delivery|returns?)|orders?\s+(over|above|of)\b|spend\s+(over|above)\b|save\s+up\s+to\b|minimum\s+(order|purchase|spend)\b|on\s+orders?\s+above\b"
CURRENCY = r"(?:₹|€|£|¥|\$|(?<![A-Za-z])(?:Rs\.?|INR|US\$|A\$|C\$|S\$|USD|EUR|GBP|JPY|AUD|CAD|CHF|SGD|AED|SAR))"
CODE = r"(?:INR|USD|EUR|GBP|JPY|AUD|CAD|CHF|SGD|AED|SAR)"
AMOUNT = r"(?:\d{1,3}(?:[,\s ]\d{2,3})+|\d+)(?:\.\d{1,2})?"
CLOCK = r"\b\d{1,3}\s*:\s*\d{2}(?:\s*:\s*\d{2})?\b"
EXECUTABLE = r"\.(exe|msi|apk|dmg|pkg|bat|scr|jar)$"
# What a price row is cleaned of, and labels that name no charge.
TOTAL_WORDS = r"\b(total|subtotal|sub-total|total amount|amount payable|grand total|order total|you pay|payable now|net payable|amount to pay)\b"
PERCENT_BADGE = r"\d[\d,.]*\s*%\s*(?:off|discount)?"
CTA_TAIL = (
    r"\b(add to (cart|bag|basket|trolley|tote)|buy now|shop now|add to wishlist|view (product|details|item)|quick view|select options|choose options"
    r"|out of stock|in stock|compare|wishlist)\b.*$"
)
ATTRIBUTE_LABELS = ["quantity", "qty", "size", "color", "colour", "availability", "condition", "brand", "category", "sku", "model", "price", "options", "product"]
NEGATIVE = r"^-|\(-|\bless\b|\bdiscount"
DISCLOSURE = r"\b(ad|advertisement|sponsored|promoted)\b"
# The shorter lists of checks that see one page at a time.
PAGE_URGENCY = [
    r"only\s+\d+\s+(left|remaining|seats?|units?|at this price)", r"hurry", r"offer ends?", r"limited time",
    r"\d+\s+people (are\s+)?(viewing|booked|bought|seeing)", r"selling fast", r"sell(ing)? out (fast|quickly)", r"\bwill sell out\b",
    r"high[\s-]?demand", r"strong demand", r"in high demand", r"\d+\s+claimed", r"claimed!", r"low(\s+in)? stock", r"limited stock",
    r"reserved for \d+", r"sale ends? (once|when)", r"\d+[^.\n]{0,20}(left|in stock|remaining)", r"\bin stock\b",
]
PAGE_GUILT = [
    r"\bi don'?t (like|want|need|care about|mind|hate|despise)\b", r"\bi'?d?\s*(rather|prefer)\s*(to\s*)?(not\s+)?(pay|have|save|win)\b",
    r"\bi don'?t feel lucky\b", r"\bi want to pay (more|the full price)\b", r"\bi do not want\b", r"\baccept (all )?(the )?risk\b",
    r"\bwithout (a )?(protection|insurance|discount)\b", r"\bi'?ll (risk|let this offer|be the last)\b", r"pay(ing)?\s*full price",
    r"like (paying )?full price", r"don'?t (mind )?miss(ing)? out", r"don'?t want \d+%",
]
PAGE_RECURRING = [
    r"\bauto[\s-]?renew(s|al|ing)?\b", r"\brecurring\b", r"\bsubscription\b", r"\bper\s+(month|year|week)\b", r"/\s*(mo|month|yr|year|week)\b",
    r"\bbilled\s+(monthly|annually|yearly)\b", r"\bmonthly\b", r"\byearly\b", r"\bannually\b", r"\bfree trial\b",
]
PAGE_DOUBLE_NEGATIVE = [
    r"\bunche?ck\b[^.]{0,60}\b(if|to)\b[^.]{0,40}\b(not|don'?t|do not|no longer|never)\b",
    r"\buntick\b[^.]{0,60}\b(if|to)\b[^.]{0,40}\b(not|don'?t|do not)\b", r"\b(do not|don'?t)\b[^.]{0,40}\b(unche?ck|untick|opt out)\b",
    r"\b(not|never)\b[^.]{0,30}\bdisagree\b",
]
PAGE_OPT_OUT = [
    r"\bdo not\b", r"\bdon'?t\b", r"\bopt out\b", r"\bunsubscribe\b", r"\bno longer\b", r"\bstop (sending|receiving)\b",
]
PAGE_CHARGE = r"₹|insurance|protection|rs\.?\s*\d"
# Kinds of personal data, in the order in which they are replaced.
REDACTIONS = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL_REDACTED]"), ("card", r"\b(?:\d[ -]*?){13,19}\b", "[CARD_REDACTED]"),
    ("id12", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[ID_REDACTED]"), ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", "[ID_REDACTED]"),
    ("mobile", r"(?:\+?91[\s-]?|\b0)?[6-9](?:[\s-]?\d){9}\b", "[PHONE_REDACTED]"), ("postal", r"(?i)\b(pin|pincode|postal code)\b[\s:-]*\d{6}\b", "[POSTAL_REDACTED]"),
]
# Codes, names and tiers of the guidelines' patterns.
PATTERNS = {
    "DP-01": ("False Urgency", "corroborated"), "DP-02": ("Basket Sneaking", "provable"), "DP-03": ("Confirm Shaming", "indicative"), "DP-04": ("Forced Action", "provable"),
    "DP-05": ("Subscription Trap", "corroborated"), "DP-06": ("Interface Interference", "corroborated"), "DP-07": ("Bait and Switch", "corroborated"), "DP-08": ("Drip Pricing", "provable"),
    "DP-09": ("Disguised Advertisement", "corroborated"), "DP-10": ("Nagging", "provable"), "DP-11": ("Trick Wording", "corroborated"), "DP-12": ("SaaS Billing", "provable"), "DP-13": ("Rogue Malware", "indicative"),
}
CAPS = {"provable": 1.0, "corroborated": 0.9, "indicative": 0.6}
