"""Fixed values of the credit-risk domain: column contracts, assumptions, thresholds, sentences.

Everything here is data, not logic.  Values that results depend on are stated plainly and together.
"""

from __future__ import annotations

# --- fixed values: raw column layout -------------------------------------------------------------
ORIGINATION_COLUMNS = [
    "credit_score", "first_payment_date", "first_time_homebuyer", "maturity_date", "msa", "mi_pct", "n_units",
    "occupancy", "cltv", "dti", "orig_upb", "ltv", "int_rate", "channel", "ppm_flag", "amort_type", "state",
    "property_type", "zip3", "loan_seq", "purpose", "orig_term", "n_borrowers", "seller_name", "super_conforming",
    "pre_relief_loan_seq", "program_indicator", "relief_refi", "property_valuation_method", "io_indicator",
    "unused_31",
]

PERFORMANCE_COLUMNS = [
    "loan_seq", "report_period", "current_upb", "delinq_status", "loan_age", "months_remaining",
    "defect_settlement_date", "modification_flag", "zero_balance_code", "zero_balance_date", "current_int_rate",
    "current_non_int_upb", "ddlpi", "mi_recoveries", "net_sale_proceeds", "non_mi_recoveries", "total_expenses",
    "legal_costs", "maintenance_costs", "taxes_insurance", "misc_expenses", "actual_loss", "cum_mod_cost",
    "step_mod_indicator", "payment_deferral_flag", "eltv", "zero_balance_removal_upb", "delinquent_accrued_interest",
    "disaster_flag", "borrower_assist_code", "current_month_mod_cost", "interest_bearing_upb", "mi_cancel_indicator",
    "servicer_name", "unused_35",
]

# Space-separated consumer-credit file: 20 inputs and the 1/2 risk column.
CONSUMER_COLUMNS = [
    "checking_account_status", "duration_months", "credit_history", "purpose", "credit_amount", "savings_account",
    "employment_length", "installment_rate", "personal_status_sex", "other_debtors", "residence_since", "property",
    "age", "other_installment_plans", "housing", "existing_credits", "job", "people_liable", "telephone",
    "foreign_worker", "risk",
]

# --- fixed values: feature-table contract --------------------------------------------------------
META = ["loan_seq", "vintage_year", "vintage_quarter", "first_payment_date", "int_rate"]
NUMERIC_FEATURES = ["credit_score", "mi_pct", "n_units", "cltv", "dti", "orig_upb", "ltv", "rate_spread", "orig_term",
                    "n_borrowers"]
CATEGORICAL_FEATURES = ["first_time_homebuyer", "occupancy", "channel", "ppm_flag", "property_type", "purpose", "state",
                        "super_conforming"]
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
LABELS = ["default_24m", "default_24m_all_late", "default_24m_loss_only"]
TARGET = "default_24m"
FRESH_EXTRA = ["several_borrowers"]
V2_NUMERIC = ["credit_score", "dti", "rate_spread", "ltv", "cltv", "several_borrowers", "mi_pct", "orig_term"]
V2_CATEGORICAL = ["purpose"]
LEAK_WORDS = ("default", "delinq", "zero_balance", "loss")

# --- fixed values: label and split rules ---------------------------------------------------------
WINDOW_MONTHS = 24
LATE_MONTHS = 3
CREDIT_EVENT_CODES = ("02", "03", "09", "15")
SEASONED_AFTER_MONTHS = 6
SHORT_TERM_MONTHS = 180
CENTURY_PIVOT = 90
SPLIT_SEED = "split-v1"
# cumulative percentages of the development pool
SPLIT_BOUNDS = (("train", 60), ("calibration", 70), ("validation", 85), ("test_in_time", 100))
DEVELOPMENT_SPLITS = ("train", "calibration", "validation")

# --- fixed values: scorecard assumptions ---------------------------------------------------------
SCALING = {"base_score": 600, "base_odds": 50, "points_to_double_odds": 20}
BINNING = {"max_bins_per_numeric": 6, "min_bin_share": 0.05, "min_category_share": 0.01, "min_iv": 0.05,
           "min_bin_rows": 30}
WOE_SMOOTH = 0.5
PROBABILITY_EPS = 1e-6

# --- fixed values: money assumptions -------------------------------------------------------------
MONEY = {
    "margin": 0.02, "margin_grid": (0.005, 0.01, 0.02, 0.03),
    "loss": 0.10, "loss_grid": (0.01, 0.05, 0.10, 0.20),
    "curve_points": 101,
}

# --- fixed values: monitoring --------------------------------------------------------------------
MONITORING = {
    "psi_warn": 0.10, "psi_alert": 0.25, "share_floor": 0.0001, "score_band_points": 20.0,
    "level_warn": (0.80, 1.25), "level_alert": (0.67, 1.50),
    "drill_seed": "20261012", "drill_batch": 10000,
    "drills": {
        "S1": {"kind": "shift", "features": ("credit_score",), "delta": -30.0},
        "S2": {"kind": "shift", "features": ("credit_score",), "delta": -10.0},
        "S3": {"kind": "shift", "features": ("dti",), "delta": 10.0},
        "S4": {"kind": "missing", "feature": "credit_score", "share": 0.10},
        "S5": {"kind": "new_category", "feature": "purpose", "value": "X", "share": 0.20},
        "S6": {"kind": "shift", "features": ("ltv", "cltv"), "delta": 10.0},
        "S7": {"kind": "shift", "features": ("rate_spread",), "delta": 0.5},
        "S8": {"kind": "default_rate", "factor": 1.25},
        "S9": {"kind": "default_rate", "factor": 2.0},
    },
    "expect_alert": ("S1", "S3", "S4", "S5", "S6", "S7", "S9"), "min_alerts": 6,
    "valid_range": {"credit_score": (300.0, 850.0), "dti": (0.0, 65.0), "ltv": (1.0, 300.0), "cltv": (1.0, 300.0)},
}
RECALIBRATION = {"label_lag_years": 3, "min_mean_improvement": 0.20, "min_targets_improved": 5,
                 "max_single_worsening": 0.30}

# --- fixed values: fairness and stability --------------------------------------------------------
SLICE_VARIABLES = ["first_time_homebuyer", "occupancy", "purpose", "property_type", "channel", "state"]
TOP_STATES = 10
MIN_SLICE_LOANS = 500
MIN_DEFAULTS_CI = 30
MIN_DEFAULTS_VINTAGE = 20
NON_INFERIORITY_MARGIN = 0.03
N_SHUFFLES = 5

# --- fixed values: approved reason sentences -----------------------------------------------------
REASON_CODES = {
    "credit_score": ("R01", "Credit score is lower than for the safest applicants", True),
    "rate_spread": ("R02", "Interest rate is above other loans of the same period and term (the lender priced extra risk)", True),
    "dti": ("R03", "Monthly debts are a high share of income (debt-to-income ratio)", True),
    "channel": ("R04", "Loan came through a channel with a higher observed default rate", True),
    "orig_term": ("R05", "Loan term differs from the lowest-risk term group", True),
    "cltv": ("R06", "Total borrowing is a high share of the property value (combined loan-to-value)", True),
    "ltv": ("R07", "Loan is a high share of the property value (loan-to-value)", True),
    "n_borrowers": ("R08", "Number of borrowers on the loan is associated with higher risk", True),
    "state": ("R09", "Property location (state) has a higher observed default rate", True),
    "mi_pct": ("R10", "Mortgage insurance coverage level is associated with higher risk", True),
    "super_conforming": ("R11", "Loan size is above the standard conforming limit", False),
    "purpose": ("R12", "Loan purpose has a higher observed default rate (for example purchase versus refinance)", True),
    "several_borrowers": ("R13", "A single borrower on the loan is associated with a higher default rate", True),
}
TOP_REASONS = 4
MIN_POINTS_LOST = 5.0

# --- fixed values: the adopted scorecard (edges and points per feature, in feature order) ---------
ADOPTED_SCALING = {"factor": 28.85390081777927, "offset": 487.1228762045055}
ADOPTED_FEATURES = {
    "credit_score": {
        "edges": [663.5, 684.5, 715.5, 737.5, 757.5],
        "points": [24.467659301872473, 38.91510079751818, 54.22109846759702, 65.77734154054704, 75.36395704648342,
                   100.0043617322456, 27.293907139724325]},
    "dti": {
        "edges": [23.5, 30.5, 38.5, 41.5, 49.5],
        "points": [91.94902143461005, 82.36635843331224, 72.38985393715717, 65.72535852787249, 59.480466736998565,
                   39.877004490885845, 38.486147589399465]},
    "rate_spread": {
        "edges": [0.1015000008046627, 0.24975000321865082, 0.37450000643730164, 0.6235000193119049, 0.8745000064373016],
        "points": [72.47389137989114, 68.95731725421854, 65.57744645659426, 62.46759829279972, 59.00533787375091,
                   55.50128391870021, 67.27618428519993]},
    "ltv": {
        "edges": [44.5, 58.5, 67.5, 82.5, 90.5],
        "points": [74.63492031627227, 70.6854369399451, 68.51800098756488, 67.20130158066385, 63.809941222328504,
                   65.36745008316483, 54.69651391834895]},
    "cltv": {
        "edges": [50.5, 58.5, 67.5, 83.5, 90.5],
        "points": [90.46014052364787, 76.88828156840368, 72.846268327914, 67.62370389060771, 54.82502680712656,
                   60.1879963654235, 27.816151832009595]},
    "several_borrowers": {
        "edges": [0.5],
        "points": [57.72163696984481, 82.02411194793001, 61.75897857543205]},
    "mi_pct": {
        "edges": [10.5, 28.5],
        "points": [67.63715018305129, 66.23681884285243, 66.7351582952961, 60.87929266131954]},
    "orig_term": {
        "edges": [347.5],
        "points": [86.63002399055163, 64.34716664594069, 67.27618428519993]},
    "purpose": {
        "categories": ["C", "N", "P"],
        "points": [58.79632296310315, 72.05050585424337, 70.19380864377672, 67.27618428519993, 67.27618428519993]},
}
ADOPTED_TRAINING_RANGES = {
    "credit_score": (500.0, 850.0), "dti": (1.0, 65.0), "rate_spread": (-3.625, 3.625), "ltv": (5.0, 100.0),
    "cltv": (5.0, 113.0), "several_borrowers": (0.0, 1.0), "mi_pct": (0.0, 42.0), "orig_term": (60.0, 480.0),
}
GOLDEN_LOAN = {"credit_score": 700.0, "dti": 44.0, "rate_spread": 0.55, "ltv": 85.0, "cltv": 85.0,
               "several_borrowers": 0.0, "mi_pct": 25.0, "orig_term": 360.0, "purpose": "P"}
GOLDEN_SCORE, GOLDEN_TOLERANCE = 553.3, 0.2

# --- fixed values: request contract (field, low, high) and allowed purposes ----------------------
REQUEST_RANGES = {
    "credit_score": (300, 850), "dti": (0, 65), "ltv": (1, 300), "cltv": (1, 300), "interest_rate": (0, 20),
    "reference_rate": (0, 20), "number_of_borrowers": (1, 10), "mi_pct": (0, 60), "term_months": (60, 600),
}
REQUEST_PURPOSES = ("P", "C", "N", "R")

# --- fixed values: decision lines and memo rules -------------------------------------------------
POLICY = {"approve_below": 0.02, "decline_above": 0.05, "min_words": 60, "max_words": 260,
          "allowed_constants": ("24",), "caution_low": "1.4", "caution_high": "2.6"}

MEMO_LANGUAGES = {
    "fr": {
        "headings": ["Résumé", "Données du dossier", "Analyse du risque", "Raisons principales", "Recommandation", "Limites"],
        "labels": {"approve": "APPROUVER", "refer": "À EXAMINER", "decline": "REFUSER"},
        "stems": {"approve": [r"approuv\w*", "approbation"], "refer": [r"examin\w*", "examen"],
                  "decline": [r"refus\w*", r"rejet\w*", "rejeté"]},
        "disclaimer": "Politique illustrative : ce mémo n'est pas une décision de crédit.",
        "caution": "Le risque affiché est une moyenne sur le cycle économique : en période calme, il a été de {low} à {high} fois le taux de défaut réellement observé.",
        "outside_range": "Valeurs hors de la plage d'entraînement du modèle : {fields}.",
        "unknown": "inconnu",
        "forbidden": ["garanti", "garantie", "sans risque", "aucun risque", "certainement", "à coup sûr", "jamais", "assuré de"],
        "spelled_numbers": ["deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix", "onze", "douze", "treize",
                            "quatorze", "quinze", "seize", "vingt", "trente", "quarante", "cinquante", "soixante", "cent",
                            "mille", "million", "pour cent", "pourcent"],
        "reason_phrases": {
            "credit_score": "Le score de crédit est plus bas que celui des emprunteurs les plus sûrs",
            "rate_spread": "Le taux d'intérêt est supérieur à celui de prêts comparables de la même période et durée",
            "dti": "Les dettes mensuelles représentent une part élevée du revenu",
            "channel": "Le canal d'origine du prêt a un taux de défaut observé plus élevé",
            "orig_term": "La durée du prêt diffère du groupe de durée le moins risqué",
            "cltv": "L'emprunt total représente une part élevée de la valeur du bien (ratio cumulé)",
            "ltv": "Le prêt représente une part élevée de la valeur du bien",
            "n_borrowers": "Le nombre d'emprunteurs est associé à un risque plus élevé",
            "state": "La localisation du bien (État) a un taux de défaut observé plus élevé",
            "mi_pct": "Le niveau d'assurance du prêt est associé à un risque plus élevé",
            "purpose": "L'objet du prêt a un taux de défaut observé plus élevé",
            "several_borrowers": "Un seul emprunteur sur le prêt est associé à un taux de défaut plus élevé",
        },
        "percent_suffix": " %", "colon": " :", "decimal_mark": ",",
        "summary": "Le modèle estime un risque de défaut de {pd} sur 24 mois. Recommandation : {label}.",
        "risk": "Score du modèle : {score} points. Probabilité de défaut estimée : {pd}. Lignes de la politique illustrative : {line1} et {line2}.",
        "lost": "{phrase} ({points} points perdus).",
        "no_reasons": "Aucune raison détaillée n'est disponible.",
        "rows": [("credit_score", "Score de crédit"), ("dti", "Dettes / revenu"), ("ltv", "Prêt / valeur du bien"),
                 ("cltv", "Emprunt total / valeur du bien"), ("interest_rate", "Taux du prêt"),
                 ("reference_rate", "Taux de référence"), ("rate_spread", "Écart de taux"),
                 ("number_of_borrowers", "Nombre d'emprunteurs"), ("mi_pct", "Assurance du prêt"),
                 ("term_months", "Durée en mois"), ("term_years", "Durée en années")],
        "sentences": {
            "approve": "Le risque estimé est inférieur à la première ligne de la politique.",
            "refer": "Le risque estimé se situe entre la première et la seconde ligne de la politique : un analyste doit examiner le dossier.",
            "decline": "Le risque estimé dépasse la seconde ligne de la politique."},
    },
    "en": {
        "headings": ["Summary", "Loan data", "Risk analysis", "Main reasons", "Recommendation", "Limits"],
        "labels": {"approve": "APPROVE", "refer": "REFER", "decline": "DECLINE"},
        "stems": {"approve": [r"approv\w*"], "refer": ["refer(?:s|red|ral|ring)?", "review(?:s|ed|ing)?"],
                  "decline": [r"declin\w*", r"reject\w*"]},
        "disclaimer": "Illustrative policy: this memo is not a credit decision.",
        "caution": "The risk shown is a through-the-cycle average: in calm years it has been {low} to {high} times the default rate really observed.",
        "outside_range": "Values outside the range the model was trained on: {fields}.",
        "unknown": "unknown",
        "forbidden": ["guarantee", "guaranteed", "risk-free", "no risk", "certainly", "definitely", "for sure", "never",
                      "will default", "will not default"],
        "spelled_numbers": ["two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
                            "thirteen", "fourteen", "fifteen", "sixteen", "twenty", "thirty", "forty", "fifty", "sixty",
                            "hundred", "thousand", "million", "percent", "per cent"],
        "reason_phrases": {},
        "percent_suffix": "%", "colon": ":", "decimal_mark": ".",
        "summary": "The model estimates a default risk of {pd} over 24 months. Recommendation: {label}.",
        "risk": "Model score: {score} points. Estimated default probability: {pd}. Lines of the illustrative policy: {line1} and {line2}.",
        "lost": "{phrase} ({points} points lost).",
        "no_reasons": "No detailed reason is available.",
        "rows": [("credit_score", "Credit score"), ("dti", "Debt to income"), ("ltv", "Loan to value"),
                 ("cltv", "Total borrowing to value"), ("interest_rate", "Loan rate"), ("reference_rate", "Reference rate"),
                 ("rate_spread", "Rate spread"), ("number_of_borrowers", "Number of borrowers"),
                 ("mi_pct", "Loan insurance"), ("term_months", "Term in months"), ("term_years", "Term in years")],
        "sentences": {
            "approve": "The estimated risk is below the first line of the policy.",
            "refer": "The estimated risk lies between the first and the second line of the policy: a human analyst should review the file.",
            "decline": "The estimated risk is above the second line of the policy."},
    },
}
MEMO_PERCENT_FIELDS = ("dti", "ltv", "cltv", "interest_rate", "reference_rate", "mi_pct", "rate_spread",
                       "probability_of_default", "approve_below", "decline_above")
SAFETY_CODES = ("NUMBER_NOT_IN_FACTS", "SPELLED_NUMBER", "DECISION_MISSING", "DECISION_CONFLICT", "DISCLAIMER_MISSING",
                "CAUTION_MISSING", "OUTSIDE_RANGE_MISSING", "RISK_MISSING", "FORBIDDEN_PHRASE", "DATA_SECTION_ALTERED")
FORM_CODES = ("EMPTY", "SECTIONS", "TEXT_OUTSIDE_SECTIONS", "EMPTY_SECTION", "LENGTH")

# fixed values: boosted trees
TREES = {"limit": 600, "step": 0.05, "depth": 3, "least_rows": 5, "row_share": 0.8, "column_share": 0.8, "patience": 40, "held_share": 0.15, "seed": 42}
FOLD_SEEDS = ("42", "43", "44")
