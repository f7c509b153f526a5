"""Table schemas. Times are wall-clock values without a zone, as the ISO texts they come from."""

REVIEWS = (
    "id string, username string, review_text string, rating int, "
    "review_date timestamp_ntz, app_version string, scraped_at timestamp_ntz"
)
TAXONOMY = "l1 string, l2 string, l3 string, l4 string, l5 string, param string"
SCORES = "review_id string, target string, ord int, label string, score double"
FLAG_EVENTS = "result_id string, flagged boolean, note string, flagged_at timestamp_ntz"
TRAINING_SET = "text string, label string"
LABELLED_REPORT_COLUMNS = ["ISI ULASAN", "LAYER 1", "LAYER 2", "LAYER 3", "LAYER 4", "LAYER 5"]

RECORD_COLUMNS = [
    "normalized", "sentiment", "sentiment_confidence", "sentiment_source", "category", "subcategory",
    "classification_confidence", "layer1", "layer2", "layer3", "layer4", "layer5", "quality_param",
    "escalated", "is_complaint", "confidence", "reason",
]
RESULTS = (
    "result_id string, review_id string, normalized_text string, sentiment string, sentiment_source string, "
    "sentiment_confidence double, is_complaint boolean, category string, subcategory string, "
    "classification_confidence double, confidence double, reason string, escalated boolean, layer1 string, "
    "layer2 string, layer3 string, layer4 string, layer5 string, quality_param string, analyzed_at timestamp_ntz"
)
