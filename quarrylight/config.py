"""Settings and cue tables. Fixed values, which must be as they are for right answers, stand in natural order; site words are settings."""

from __future__ import annotations

#: The site whose pages count as the website, its address, and hosts that may be opened.
SITE_DOMAIN = "example.com"
SITE = "https://www.example.com"
OPENABLE_HOSTS = ("example.com", "drive.google.com", "docs.google.com", "wa.me", "chat.whatsapp.com")

# Sources, their families of words, and phrases that lift any restriction.
SOURCES = ("all", "website", "drive", "whatsapp")
SOURCE_CUES = {
    "whatsapp": r"(?i)\b(?:whatsapp|whats\s*app|wa\s*chats?|wa\s*groups?)\b",
    "website": r"(?i)\b(?:blogs?|blog\s*posts?|articles?)\b|\b(?:from|on|in|check(?:\s+the)?|using|via)\s+(?:the\s+)?(?:website|site)\b|\b(?:product[\s-]?details?|service\s+pages?|package\s+pages?|country\s+pages?|business\s+setup|micro[\s-]?services?)\b|\b(?:from|on|in)\s+(?:the\s+)?(?:catalog|services?|packages?)\b",
    "drive": r"(?i)\bgoogle\s*drive\b|\b(?:from|in|on|check(?:\s+the)?|using|via|search)\s+(?:the\s+|our\s+|my\s+)?(?:google\s*)?drive\b|\bdrive\s+(?:docs?|documents?|files?|pdfs?)\b",
}
FORCE_ALL = r"(?i)\b(?:all\s+sources|everything|both|as\s+well|also\s+from|blogs?\s+too|website\s+too|drive\s+too|whatsapp\s+too)\b"
EMPTY_ANSWERS = {"all": "Nothing was found.", "website": "Nothing was found on the website.", "drive": "Nothing was found in the drive.", "whatsapp": "Nothing was found in the chats."}
SHORT_QUESTION = 12

# Fees, codes, pricing rows and vendors that are noise beside them.
FEE_QUERY = r"(?i)\b(?:fee|fees|pricing|price|cost|charges?|tariff|authority\s+fee|service\s+code|who\s+pays|who\s+remits|handles?\s+payment|payment\s+for|payer|pm\d{3,})\b"
SERVICE_CODE = r"(?i)\bPM\s*-?\s*(\d{3,})\b"
PRICING_TITLE = r"(?i)pricing\s*master"
PRICING_ROW = r"(?i)(?:authority\s+fees?|service\s+code|pm\s*id\s*:|pm\d{3,})"
VENDOR_NOISE = r"(?i)\b(?:razorpay|payment\s+gateway|stripe|paypal|online\s+payment\s+gateway\s+service)\b"
ROW_TITLE = r"(?im)^Title:[ \t]*([^\n]+)$"
MIN_TITLE = 20

# What lists and sections are called.
LIST_INTENT = r"(?is)\b(key\s+selling\s+points?|selling\s+points?|faqs?|frequently\s+asked|application\s+process|process\s+(flow|steps?)|top\s+funds?|explore\s+funds?|top\s+packages?|explore\s+packages?|\bpackages?\b|compar(?:e|ison|ing)|vs\.?|versus|list\s+(all|the|every)|all\s+\d+|country\s+page|exactly|verbatim|numbered)\b"
SECTION_CUES = (
    (r"(?is)\b(key\s+selling\s+points?|selling\s+points?)\b", ("selling_points",)),
    (r"(?is)\b(faqs?|frequently\s+asked)\b", ("faq", "faqs")),
    (r"(?is)\b(application\s+process|process\s+(flow|steps?))\b", ("process_flow",)),
    (r"(?is)\b(top\s+funds?|explore\s+funds?)\b", ("top_funds", "top_packages")),
    (r"(?is)\b(top\s+packages?|explore\s+packages?|\bpackages?\b)\b", ("top_packages", "top_funds")),
    (r"(?is)\b(compar(?:e|ison|ing)|vs\.?|versus|setup timeline|corporate tax|vat|gst)\b", ("compare",)),
)
CATALOG_SECTIONS = ("selling_points", "faq", "faqs", "process_flow", "top_funds", "top_packages", "market_insights", "overview", "compare", "introduction", "highlights", "highlights_and_benefits", "terms", "terms_and_conditions", "documents", "pricing")
COUNTRY_CUES = (
    (r"(?is)\bhong\s*kong\b|\b/hk\b", ("hk", "hong kong", "hong-kong")),
    (r"(?is)\bguernsey\b|\b/gg\b", ("gg", "guernsey")),
    (r"(?is)\buae\b|united arab emirates|\b/ae\b", ("ae", "uae")),
    (r"(?is)\bsaudi\b|\bksa\b|\b/sa\b", ("sa", "saudi")),
    (r"(?is)\bsingapore\b|\b/sg\b", ("sg", "singapore")),
    (r"(?is)\bmauritius\b|\b/mu\b", ("mu", "mauritius")),
    (r"(?is)\bcyprus\b|\b/cy\b", ("cy", "cyprus")),
    (r"(?is)\bireland\b|\b/ie\b", ("ie", "ireland")),
    (r"(?is)\bluxembourg\b|\b/lu\b", ("lu", "luxembourg")),
    (r"(?is)\bmalaysia\b|\b/my\b", ("my", "malaysia")),
    (r"(?is)\bcayman\b|\b/cym\b", ("cym", "cayman")),
    (r"(?is)\bbvi\b|british virgin|\b/vg\b", ("vg", "virgin", "bvi")),
    (r"(?is)\bpuerto\s*rico\b|\b/pr\b", ("pr", "puerto")),
    (r"(?is)\bunited\s+kingdom\b|\buk\b|\b/gb\b", ("gb", "uk", "united kingdom", "united-kingdom")),
    (r"(?is)\bsaint\s+vincent|\bst\.?\s*vincent|\b/vc\b", ("vc", "vincent", "grenadines")),
)

# How questions call countries and services, and the names that catalogs have for them.
COUNTRY_ALIASES = (
    (r"(?is)\bhong\s*kong\b", "Hong Kong"),
    (r"(?is)\bsaint\s+vincent|\bst\.?\s*vincent|\bgrenadines\b", "Saint Vincent and the Grenadines"),
    (r"(?is)\bbritish\s+virgin|\bbvi\b", "British Virgin Islands"),
    (r"(?is)\bcayman\b", "Cayman Island"),
    (r"(?is)\bsaudi\b|\bksa\b|kingdom\s+of\s+saudi", "Saudi Arabia"),
    (r"(?is)\bunited\s+arab|\buae\b", "UAE"),
    (r"(?is)\bunited\s+kingdom\b|\buk\b|\bgreat\s+britain\b", "United Kingdom"),
    (r"(?is)\bpuerto\s*rico\b", "Puerto Rico"),
    (r"(?is)\bluxembourg\b", "Luxembourg"),
    (r"(?is)\bsingapore\b", "Singapore"),
    (r"(?is)\bmauritius\b", "Mauritius"),
    (r"(?is)\bcyprus\b", "Cyprus"),
    (r"(?is)\bireland\b", "Ireland"),
    (r"(?is)\bmalaysia\b", "Malaysia"),
    (r"(?is)\bguernsey\b", "Guernsey"),
)
SERVICE_ALIASES = (
    (r"(?is)\bpost[\s-]?setup\b", "Post Setup Compliance"),
    (r"(?is)\bvisa\b", "Visa Services"),
    (r"(?is)\battestat", "Attestation"),
    (r"(?is)\baccounting\b|\bbook\s*keep|\bbookeep", "Accounting & Bookkeeping"),
    (r"(?is)\blegal\b", "Legal Services"),
    (r"(?is)\bproduct\s+registration\b|\bcertification\b", "Product Registration & Certification"),
    (r"(?is)\bliquidat", "Liquidation"),
    (r"(?is)\bbanking\b", "Banking Services"),
    (r"(?is)\bwill\b|\bdrafting\b", "Will Drafting Services"),
    (r"(?is)\binsights?\b|\bbusiness\s+guides?\b", "Product Insights & Guides"),
    (r"(?is)\bfunds?\b", "Funds"),
    (r"(?is)\bother\s+services?\b", "Other Services"),
)

# Package details and documents.
DOCUMENTS_QUERY = r"(?is)\b(documents?\s+required|required\s+documents?|what\s+documents?\b|which\s+documents?\b|docs?\s+needed|documents?\s+needed|supporting\s+documents?)\b"
PACKAGE_INTENT = r"(?is)\b(package\s+detail(?:\s+page)?|product\s+detail(?:\s+page)?|summarize\s+the\s+introduction|introduction,\s*highlights|highlights\s*/\s*benefits|process\s+flow,\s*faqs?|documents?\s+required|required\s+documents?|what\s+documents?\b|which\s+documents?\b|docs?\s+needed|documents?\s+needed|supporting\s+documents?)\b"
PACKAGE_SECTIONS = ("introduction", "highlights_and_benefits", "highlights", "process_flow", "faqs", "faq", "terms_and_conditions", "terms", "pricing", "documents", "documents_required", "documents_from_authority")
DOCUMENT_SECTIONS = ("documents_required", "documents", "documents_from_authority", "more_about_required_documents")

# Counting and comparing.
SERVICE_COUNT = r"(?is)\b(how\s+many\s+(?:packages?|products?|skus?|services?)\b|(?:number|count)\s+of\s+(?:packages?|products?)\b|packages?\s+(?:are\s+)?(?:there|available|listed)\b|list\s+(?:all\s+)?(?:the\s+)?packages?\b)"
LOCATION_COUNT = r"(?is)\b(how\s+many\s+(?:funds?|packages?|products?|licen[cs]es?)\b|(?:number|count)\s+of\s+(?:funds?|packages?)\b|(?:funds?|packages?)\s+(?:are\s+)?(?:there|available|listed)\b|list\s+(?:all\s+)?(?:the\s+)?(?:top\s+)?(?:funds?|packages?)\b)"
COMPARE_QUERY = r"(?is)\b(compar(?:e|ison|ing)|\bvs\.?\b|versus|difference(?:s)?\s+between|how\s+does\s+.+\s+differ)\b"
LIST_WORD = r"(?is)\blist\b|\ball\b|\bshow\b"
FUNDS_CUE = r"(?is)\bfunds?\b"
PACKAGES_CUE = r"(?is)\bpackages?|licen[cs]es?|products?\b"
PREFERRED_KEYS = ("Setup Timeline", "Capital Requirement", "Corporate Tax Rate", "VAT Rate", "Virtual Company Setup", "Foreign Ownership", "Visa Application", "International Market Access", "Tax Incentives", "Banking", "Annual Compliance", "Preferred Business Activities")

# Follow-ups that go with the turn before.
ELLIPTICAL = r"(?is)^\s*(?:(?:what|how)\s+about\s+(?:the\s+)?(?:cost|fees?|price|pricing|documents?|requirements?|timeline|process|that|this|it)\??|and\s+(?:the\s+)?(?:cost|fees?|price|documents?|requirements?|that|this|it)\??|how\s+much(?:\s+(?:is\s+it|are\s+they|does\s+it\s+cost|for\s+(?:that|this|it)))?\??|(?:the\s+)?(?:cost|fees?|price|documents?(?:\s+required)?|requirements?|timeline)\??|what\s+(?:are\s+the\s+)?(?:required\s+)?documents?(?:\s+are)?(?:\s+required|\s+needed)?\??|which\s+documents?(?:\s+are)?(?:\s+required|\s+needed)?\??|documents?\s+(?:required|needed)\??|what\s+(?:is\s+the\s+)?process(?:\s+flow|\s+steps?)?\??|(?:and\s+)?(?:from\s+)?(?:whatsapp|blog|website|drive|the\s+website)\??|(?:top\s+)?packages?\??|(?:key\s+)?selling\s+points?\??|faqs?\??|(?:application\s+)?process(?:\s+flow|\s+steps?)?\??|(?:top\s+|explore\s+)?funds?\??)\s*$"

# Limits of an answer: (returned, per address, candidates).
LIMITS, LIST_LIMITS, PACKAGE_LIMITS = (5, 2, 20), (12, 10, 40), (12, 8, 40)
MIN_SCORE = 0.45

# Noise in pages.
NOISE_TEXT = r"(?i)get in touch|join our newsletter|related articles|book a consultation|summarize this article|chatgpt|perplexity|load more|more articles by themes"
MIN_BLOCK_CHARS = 20
BYLINE_HEADING = r"(?i)^\s*by\s+.+\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b.+\d{4}.*(?:min\s+read)?\s*$"
TOC_HEADING = r"(?i)table of contents"
BREADCRUMB_HEADING = r"(?i)^blogs?\b"
TOC_WORDS = ("introduction", "conclusion", "faq", "faqs", "step-by-step", "guide")
CRUMBS = r"(?i)\b(?:Read More|Show More|View More|Learn More)\b\.?"
ANNOUNCEMENT_ENDS = ("view article", "notify me", "related articles", "related events", "you may also like", "share this", "back to all", "upcoming events", "archived events")
SECTION_ALIASES = (
    (r"(?i)selling point|why choose", "selling_points"),
    (r"(?i)\bfaqs?\b|frequently asked", "faqs"),
    (r"(?i)process", "process_flow"),
    (r"(?i)document", "documents_required"),
    (r"(?i)highlight|benefit", "highlights_and_benefits"),
    (r"(?i)terms", "terms_and_conditions"),
    (r"(?i)price|pricing|fee", "pricing"),
    (r"(?i)introduction|overview|about", "introduction"),
)

# Addresses.
KEEP_QUERY_PATHS = ("/product-listing", "/services/funds")
KEEP_QUERY_KEYS = ("countries", "producttype", "authority")
DENIED_PREFIXES = ("/checkout", "/cart", "/account", "/api/", "/admin", "/private", "/cost-calculator", "/aml-screener", "/products/free-ai-assistance", "/products/affiliate-program", "/career", "/privacy-policy", "/terms-conditions")
COUNTRY_PATHS = ("/ae", "/sa", "/ksa", "/sg", "/uk", "/gb", "/hk", "/my", "/cy", "/ie", "/lu", "/mu", "/gg", "/vg", "/bvi", "/ky", "/pr", "/vc", "/svg")
SKIPPED_KINDS = ("package_listing", "hub")
PRICE_KINDS = ("pricing", "service", "product", "jurisdiction", "fund", "service_landing", "service_package", "product_detail", "country_overview")

# Evaluation.
MAX_DROP = 0.05
STOP_WORDS = ("the", "and", "for", "with", "that")
PACKAGE_STOPS = ("the", "and", "or", "of", "a", "an", "in", "for", "to", "with", "package", "setup", "company", "formation", "incorporation")
SERVICE_FAMILIES = (("funds", "fund"), ("licence", "license", "setup", "business setup"))
NARROW_SECTIONS = ("introduction", "highlights_and_benefits", "highlights", "process_flow", "faqs", "faq", "terms_and_conditions", "terms", "pricing")
CARD_PRICE = r"(?i)(AED|SAR|USD|SGD|EUR|GBP)\s*[\d,]+(?:\.\d+)?"
