"""Floating-point output columns per oracle query (generated by scripts/float_columns.py)."""

FLOAT_COLUMNS = {
    'align_schema': ['c_nationkey', 'c_acctbal'],
    'average_precision': ['average_precision'],
    'batch_score_threshold': ['prob_1'],
    'best_run': ['metric_value'],
    'best_run_by_score': ['metric_value'],
    'best_threshold': ['default_threshold', 'optimal_threshold', 'best_f1'],
    'choose_scaler': ['outlier_share'],
    'class_weights': ['_sample_weight'],
    'clean_dataframe': ['c_acctbal'],
    'clip_iqr': ['value'],
    'correlation_matrix': ['corr'],
    'kfold_training': ['score_val'],
    'leaderboard_multiclass': ['score_val'],
    'text_tfidf': ['tfidf_norm'],
    'trial_search': ['score', 'best_so_far'],
    'permutation_rule': ['importance_mean', 'importance_std'],
    'shap_rule': ['phi', 'base_value', 'prediction', 'feature_value'],
    'strategy_user_choice': ['imbalance_ratio', 'holdout_frac'],
    'strategy_many_classes': ['imbalance_ratio', 'holdout_frac'],
    'correlation_with_nulls': ['corr'],
    'pca_two_columns': ['explained_ratio', 'first_loading'],
    'cyclical_dates': ['o_orderdate_month_sin', 'o_orderdate_month_cos', 'o_orderdate_dayofweek_sin', 'o_orderdate_dayofweek_cos'],
    'datetime_string_check': ['date_ratio'],
    'drop_columns': ['o_totalprice'],
    'drop_duplicates': ['l_quantity', 'l_discount'],
    'drop_high_missing_columns': ['o_totalprice'],
    'drop_null_target': ['o_totalprice'],
    'duplicate_rows': ['score'],
    'ensemble_fallback': ['improvement_ratio'],
    'high_cardinality_columns': ['unique_ratio'],
    'id_like_columns': ['unique_ratio'],
    'imbalance_ratio': ['imbalance_ratio'],
    'impute_constant': ['c_acctbal'],
    'impute_mean': ['c_acctbal'],
    'impute_median': ['c_acctbal'],
    'infer_target': ['confidence'],
    'iqr_bounds': ['lower', 'upper'],
    'iqr_outliers': ['q1', 'q3', 'lower_bound', 'upper_bound', 'outlier_ratio'],
    'label_encode_decode': ['c_mktsegment_code'],
    'leaderboard': ['score_val'],
    'leaderboard_metrics': ['score_val'],
    'log_loss': ['log_loss'],
    'log_skewed': ['value', 'value_log'],
    'macro_pr_grid': ['recall', 'precision'],
    'macro_roc_grid': ['fpr', 'tpr'],
    'mcc_kappa_balanced': ['accuracy', 'mcc', 'cohens_kappa', 'balanced_accuracy'],
    'metrics_by_split': ['accuracy', 'error_rate'],
    'metrics_table': ['metric_value'],
    'missing_rates': ['missing_rate'],
    'mixed_type_columns': ['numeric_like_ratio'],
    'ovr_auc': ['auc', 'average_precision'],
    'ovr_auc_macro': ['auc_macro', 'ap_macro'],
    'pr_curve': ['threshold', 'precision', 'recall'],
    'prf_averages': ['precision_macro', 'recall_macro', 'f1_macro', 'precision_weighted', 'recall_weighted', 'f1_weighted', 'precision_micro', 'recall_micro', 'f1_micro'],
    'prf_by_label': ['precision', 'recall', 'f1'],
    'profile_table': ['missing_rate', 'unique_ratio'],
    'quality_accuracy': ['score'],
    'quality_completeness': ['score'],
    'quality_consistency': ['score'],
    'quality_overall': ['score'],
    'quality_sample': ['o_totalprice'],
    'quality_timeliness': ['score'],
    'quality_validity': ['score'],
    'range_constraint': ['l_quantity', 'l_discount'],
    'read_csv_roundtrip': ['total'],
    'read_parquet_table': ['qty'],
    'regression_metrics': ['mae', 'mse', 'rmse', 'r2', 'mape', 'smape', 'residual_mean', 'residual_std'],
    'residual_histogram': ['lower', 'upper'],
    'roc_auc': ['auc'],
    'roc_curve': ['threshold', 'fpr', 'tpr'],
    'run_compare': ['accuracy', 'log_loss', 'n_rows'],
    'run_summary': ['best_score'],
    'sample_rows': ['value'],
    'sampling_choice': ['imbalance_ratio'],
    'scale_minmax': ['user_id', 'value'],
    'scale_robust': ['user_id', 'value'],
    'scale_standard': ['user_id', 'value'],
    'schema_constraints': ['min_value', 'max_value'],
    'schema_validate': ['observed', 'limit'],
    'sequential_check': ['seq_ratio'],
    'strategy_recommendation': ['imbalance_ratio', 'holdout_frac'],
    'target_distribution_numeric': ['mean', 'std', 'min', 'max'],
    'target_encode': ['user_cat_te'],
    'target_encode_unseen': ['cust_te'],
    'trial_best_so_far': ['val_score', 'best_so_far'],
    'variance_drop': ['var_pop'],
    'write_reports': ['uniqueness_score'],
    'write_split_parquet': ['total'],
}
