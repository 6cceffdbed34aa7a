"""Word lists, weights and dictionaries of the text operators."""

# Words counted by the keyword sentiment.
POSITIVE_WORDS = [
    "bullish", "positive", "up", "gain", "growth", "profit", "beat", "strong", "outperform", "buy", "upgrade", "bull",
    "rise", "surge", "rally", "boom", "success", "wins", "breakthrough", "record", "high", "soar",
]
NEGATIVE_WORDS = [
    "bearish", "negative", "down", "loss", "decline", "miss", "weak", "underperform", "sell", "downgrade", "bear",
    "fall", "drop", "crash", "bust", "failure", "loses", "problem", "low", "plunge", "collapse",
]

# Event types with (keywords, weight, required terms), in type order.
EVENT_PATTERNS = {
    "earnings": (
        [
            "earnings", "quarterly results", "financial results", "revenue", "profit", "eps", "earnings per share",
            "quarterly report", "fiscal quarter", "beats estimates", "misses estimates", "guidance", "outlook",
        ],
        1.0,
        ["earnings", "quarter", "revenue"],
    ),
    "merger_acquisition": (
        [
            "merger", "acquisition", "buyout", "takeover", "acquires", "merges with", "deal", "purchase",
            "acquisition agreement", "merger agreement", "bought by", "sells to",
        ],
        1.0,
        ["acquisition", "merger", "deal"],
    ),
    "product_launch": (
        [
            "launches", "introduces", "announces new", "unveils", "product release", "new product", "innovation",
            "breakthrough", "patent", "technology",
        ],
        0.8,
        ["new", "product", "launch"],
    ),
    "regulatory": (
        [
            "fda approval", "regulatory approval", "sec", "investigation", "lawsuit", "legal action", "court", "ruling",
            "compliance", "violation", "fine", "penalty", "regulatory filing", "antitrust",
        ],
        0.9,
        ["regulatory", "fda", "sec", "legal"],
    ),
    "leadership_change": (
        [
            "ceo", "chief executive", "president", "chairman", "resigns", "steps down", "appointed", "hired",
            "executive", "management change", "leadership", "board of directors",
        ],
        0.7,
        ["ceo", "executive", "management"],
    ),
    "partnership": (
        [
            "partnership", "collaboration", "joint venture", "alliance", "agreement", "contract", "deal",
            "partners with", "teams up", "cooperation",
        ],
        0.6,
        ["partnership", "agreement", "collaboration"],
    ),
    "legal_issue": (
        [
            "lawsuit", "litigation", "court case", "legal battle", "settlement", "damages", "trial", "judge", "jury",
            "verdict", "appeal", "injunction",
        ],
        0.8,
        ["lawsuit", "court", "legal"],
    ),
    "market_movement": (
        [
            "stock price", "shares", "market cap", "valuation", "trading", "volume", "price target", "upgrade",
            "downgrade", "analyst", "recommendation",
        ],
        0.5,
        ["stock", "price", "trading"],
    ),
    "economic_data": (
        [
            "gdp", "inflation", "unemployment", "interest rate", "federal reserve", "fed", "economic data",
            "consumer price index", "cpi", "jobs report",
        ],
        0.9,
        ["economic", "gdp", "inflation", "fed"],
    ),
}
EVENT_TYPES = [*EVENT_PATTERNS, "unknown"]

# Entity candidate patterns.
UPPERCASE_WORD = r"\b[A-Z]{2,5}\b"
COMPANY_WORDS = r"\b([A-Z][a-z]+ (?:Inc|Corp|LLC|Ltd|Company|Technologies|Systems|Group))\b"
COMPANY_SUFFIX = r"\b[A-Z][a-zA-Z\s&\.]{2,30}\s+(Inc\.|Corp\.|Corporation|Company|Co\.|Ltd\.)"
PERCENTAGE = r"(\d+(?:\.\d+)?)\s*%"
DOLLARS = r"\$(\d+(?:\.\d+)?)\s*(million|billion|m|b)"

# Base impact per event type; 0.5 for any other type.
BASE_IMPACT = {
    "earnings": 0.7,
    "merger_acquisition": 0.9,
    "regulatory": 0.8,
    "leadership_change": 0.4,
    "product_launch": 0.5,
    "legal_issue": 0.6,
    "partnership": 0.3,
    "market_movement": 0.4,
    "economic_data": 0.6,
}
# Factors applied to the base impact.
BEAT_FACTOR, MISS_FACTOR, GUIDANCE_FACTOR = 1.5, 1.8, 1.3
FDA_FACTOR, SEC_FACTOR, CEO_FACTOR = 1.8, 1.6, 1.8
MEGA_CAPS = ["AAPL", "MSFT", "GOOGL", "AMZN", "TSLA", "META", "NVDA"]
LARGE_CAPS = ["NFLX", "AMD", "CRM", "ADBE", "PYPL", "INTC", "ORCL"]
HIGH_PROFILE = ["TSLA", "AAPL", "AMZN", "GOOGL", "META"]
MEGA_FACTOR, LARGE_FACTOR, PROFILE_FACTOR = 0.7, 0.8, 1.2
MARKET_FACTORS = {
    "high_volatility": 1.3,
    "low_volatility": 0.8,
    "bull_market": 1.1,
    "bear_market": 1.4,
    "earnings_season": 1.2,
    "holiday_period": 0.7,
    "market_hours": 1.0,
    "after_hours": 1.3,
}

# Tickers and company names.
TICKERS = {
    "AAPL": "Apple Inc.",
    "MSFT": "Microsoft Corporation",
    "GOOGL": "Alphabet Inc.",
    "GOOG": "Alphabet Inc.",
    "AMZN": "Amazon.com Inc.",
    "TSLA": "Tesla Inc.",
    "META": "Meta Platforms Inc.",
    "NVDA": "NVIDIA Corporation",
    "NFLX": "Netflix Inc.",
    "AMD": "Advanced Micro Devices Inc.",
    "CRM": "Salesforce Inc.",
    "ADBE": "Adobe Inc.",
    "PYPL": "PayPal Holdings Inc.",
    "INTC": "Intel Corporation",
    "ORCL": "Oracle Corporation",
    "JPM": "JPMorgan Chase & Co.",
    "BAC": "Bank of America Corporation",
    "WMT": "Walmart Inc.",
    "JNJ": "Johnson & Johnson",
    "PG": "Procter & Gamble Company",
    "V": "Visa Inc.",
    "MA": "Mastercard Incorporated",
    "HD": "Home Depot Inc.",
    "DIS": "Walt Disney Company",
    "COIN": "Coinbase Global Inc.",
    "SQ": "Block Inc.",
    "SHOP": "Shopify Inc.",
    "SPOT": "Spotify Technology S.A.",
    "UBER": "Uber Technologies Inc.",
    "LYFT": "Lyft Inc.",
    "ABNB": "Airbnb Inc.",
    "ROKU": "Roku Inc.",
    "ZM": "Zoom Video Communications Inc.",
    "SNOW": "Snowflake Inc.",
    "PLTR": "Palantir Technologies Inc.",
    "BTC-USD": "Bitcoin",
    "ETH-USD": "Ethereum",
}
# The later ticker wins where two share a company.
COMPANY_TICKER = {company: ticker for ticker, company in TICKERS.items()}

# Company aliases, in match order.
ALIASES = {
    "Apple": "Apple Inc.",
    "Microsoft": "Microsoft Corporation",
    "Google": "Alphabet Inc.",
    "Amazon": "Amazon.com Inc.",
    "Tesla": "Tesla Inc.",
    "Facebook": "Meta Platforms Inc.",
    "Meta": "Meta Platforms Inc.",
    "Nvidia": "NVIDIA Corporation",
    "Netflix": "Netflix Inc.",
    "Intel": "Intel Corporation",
    "Oracle": "Oracle Corporation",
    "JPMorgan": "JPMorgan Chase & Co.",
    "Bank of America": "Bank of America Corporation",
    "BofA": "Bank of America Corporation",
    "Walmart": "Walmart Inc.",
    "Johnson & Johnson": "Johnson & Johnson",
    "J&J": "Johnson & Johnson",
    "Visa": "Visa Inc.",
    "Mastercard": "Mastercard Incorporated",
    "Home Depot": "Home Depot Inc.",
    "Disney": "Walt Disney Company",
    "Coinbase": "Coinbase Global Inc.",
    "Square": "Block Inc.",
    "Shopify": "Shopify Inc.",
    "Spotify": "Spotify Technology S.A.",
    "Uber": "Uber Technologies Inc.",
    "Lyft": "Lyft Inc.",
    "Airbnb": "Airbnb Inc.",
    "Roku": "Roku Inc.",
    "Zoom": "Zoom Video Communications Inc.",
    "Snowflake": "Snowflake Inc.",
    "Palantir": "Palantir Technologies Inc.",
    "Bitcoin": "Bitcoin",
    "BTC": "Bitcoin",
    "Ethereum": "Ethereum",
    "ETH": "Ethereum",
}

# Sector keywords, in sector order.
SECTORS = {
    "Technology": [
        "tech", "software", "cloud", "AI", "artificial intelligence", "machine learning", "digital", "internet",
        "semiconductor",
    ],
    "Financial": [
        "bank", "finance", "credit", "loan", "investment", "insurance", "payment", "fintech", "trading", "broker",
    ],
    "Healthcare": [
        "pharma", "medical", "drug", "biotech", "hospital", "FDA", "clinical", "therapy", "treatment",
    ],
    "Consumer": ["retail", "consumer", "brand", "product", "store", "e-commerce", "shopping", "subscription"],
    "Energy": ["oil", "gas", "energy", "renewable", "solar", "wind", "electric"],
    "Automotive": ["car", "auto", "vehicle", "electric vehicle", "EV", "automotive"],
    "Real Estate": ["real estate", "property", "housing", "REIT"],
    "Crypto": ["crypto", "blockchain", "bitcoin", "ethereum", "NFT", "DeFi"],
}
