"""Fixed values of the cohort: they must equal the study's for its results to come out."""

# Sample types in clinical order.
SAMPLE_TYPES = ["Healthy", "Diagnosis", "MRD timepoints", "Relapse"]

# Time points counted as minimal residual disease.
MRD_TIMEPOINTS = ["D8", "D15", "D33", "D78"]

# Stages of B-cell development in order.
B_LINEAGE = [
    "HSC",
    "LMPP",
    "CLP",
    "MLP",
    "MLP-II",
    "Pre-ProB",
    "Pro-B VDJ",
    "Pro-B Cycling",
    "Large Pre-B",
    "Small Pre-B",
    "Immature B",
    "Mature B",
    "Plasma Cell",
]

# Gene signatures.
SIGNATURES = {
    "ComplexI": (
        "NDUFA1 NDUFA2 NDUFA3 NDUFA4 NDUFA5 NDUFA6 NDUFA7 NDUFA8 NDUFA9 NDUFB1 NDUFB2 NDUFB3 NDUFB4 NDUFB5 NDUFB6 "
        "NDUFB7 NDUFB8 NDUFB9 NDUFC1 NDUFC2 NDUFS1 NDUFS2 NDUFS3 NDUFV1 NDUFS4 NDUFS5 NDUFS6 NDUFS8 NDUFV2 NDUFV3 NDUFS7"
    ).split(),
    "Mito_ETC": "CYCS CYC1 CS COX5A ATP5A ATP5B".split(),
    "Pyrimidine_synthesis": "DHODH CAD UMPS".split(),
}
