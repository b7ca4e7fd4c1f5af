"""Column types of the cohort tables; nothing is inferred from the files."""

METADATA = "individual STRING, timepoint STRING, condition STRING, MRD_risk STRING, relapse STRING"

CELLS = (
    "cell_id STRING, row_idx BIGINT, orig_ident STRING, ident STRING, Sample_Name STRING, individual STRING, "
    "timepoint STRING, MRD_risk STRING, relapse STRING, sample_type STRING, Cell_Type_Experimental STRING, "
    "BCR_Paired_Chains STRING, nCount_RNA BIGINT, gate STRING, predicted_BMM STRING, predicted_BMM_proba DOUBLE, "
    "label STRING"
)

EXPRESSION = "cell_id STRING, gene STRING, count BIGINT, logcount DOUBLE"

GATES = "row_idx BIGINT, Sample_Name STRING, OmiqFileIndex STRING, OmiqFilter STRING"

SIGNATURES = "signature STRING, gene STRING"

ID_MAP = "symbol STRING, entrez STRING"

TERMS = "term_id STRING, term_name STRING, entrez STRING"

REF_EMBEDDINGS = "ref_id STRING, label STRING, embedding ARRAY<DOUBLE>"

REF_LOADINGS = "gene STRING, mean DOUBLE, sd DOUBLE, weights ARRAY<DOUBLE>"
