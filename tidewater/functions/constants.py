"""Fixed values the results depend on.

Everything here is a constant of the model being rebuilt; keep the values
as written (natural order) so results stay comparable.
"""

# --- fixed values: interaction weights (feature path, case/space-insensitive, unknown -> 1.0)
INTERACTION_WEIGHTS = {"view": 1.0, "click": 2.0, "add_to_cart": 3.0, "purchase": 5.0, "reorder": 7.0}
UNKNOWN_WEIGHT = 1.0

# --- fixed values: raw-path weights (case-sensitive, unknown -> null)
RAW_WEIGHTS = {"view": 1.0, "click": 2.0, "purchase": 5.0}

# --- fixed values: recency decay rates per day
CUSTOMER_DECAY = 0.005
OWNER_DECAY = 0.003

# --- fixed values: hybrid product ranker
HYBRID_ALPHA = 0.4          # content weight; collaborative weight is 1 - alpha
DEFAULT_TOP_K = 5
POPULAR_PRODUCTS_N = 50
POPULAR_MATERIALS_N = 20
COLD_START_SCORE = 0.5

# --- fixed values: material ranker weights and scalings
W_VOLUME, W_URGENCY, W_FORECAST, W_SIMILARITY = 0.3, 0.3, 0.2, 0.2
VOLUME_SCALE = 15.0          # volume = min(1, count / 15)
URGENCY_HORIZON = 7.0        # feature path urgency = min(1, 7 / cycle)
FORECAST_SCALE = 200.0       # forecast score = min(1, qty / 200)
FEATURE_PATH_ELAPSED = 7     # simulated days elapsed on the feature path
COLD_DEMAND, COLD_ELAPSED, COLD_CYCLE = 50.0, 7, 14
CYCLE_MIN, CYCLE_MAX, CYCLE_SINGLE = 3.0, 90.0, 21.0
DEFAULT_INTERVAL_DAYS = 30.0
DEFAULT_MEAN_QTY = 10.0
RIDGE_ALPHA = 1.0
FORECAST_FEATURES = ["lag_1", "lag_2", "lag_3", "rolling_mean_3", "owner_mean_qty", "material_mean_qty"]

# --- fixed values: evaluation
EVAL_KS = (5, 10)
TRAIN_FRACTION = 0.85
PROMOTION_BASELINE_ACTIVE = 0.01

# --- fixed values: older (KNN / co-purchase) rankers
KNN_NEIGHBORS = 20
KNN_W_CF, KNN_W_CB = 0.7, 0.3
PREFERRED_SCORE, OTHER_CATEGORY_SCORE = 1.0, 0.3
INDUSTRY_RULE_SCORE = 0.5
INDUSTRY_RULE_WEIGHT = 0.5
REASON_SIMILAR = "Similar to "
REASON_TRENDS = "Based on production trends"
REASON_POPULAR = "Popular material"

# --- fixed values: notebook hybrid
NOTEBOOK_ALPHA = 0.7
NOTEBOOK_RELEVANT_RATING = 4
SVD_RANK = 50

# --- fixed values: token pattern (two or more word characters)
TOKEN_PATTERN = r"\b\w\w+\b"

# --- fixed values: English stop words (Spark ML StopWordsRemover default list, in its order)
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll "
    "they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()
