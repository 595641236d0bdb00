"""What a query may be made of. These lists are closed: what isn't in them is refused."""

from __future__ import annotations

PLAN_NODES = frozenset(
    "UnresolvedWith SubqueryAlias UnresolvedSubqueryColumnAliases Project Filter Join Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit "
    "Offset Distinct Union Intersect Except UnresolvedRelation WithWindowDefinition".split()
)

#: Nodes that have a code of their own; any other unknown node is ``sql.forbidden``.
REFUSED_NODES = {
    "RelationTimeTravel": "sql.forbidden",
    "Sample": "sql.forbidden",
    "PipeOperator": "sql.forbidden",
    "UnresolvedInlineTable": "sql.forbidden",
    "UnresolvedTableValuedFunction": "sql.table_function",
    "UnresolvedTVFAliases": "sql.table_function",
    "Generate": "sql.function",
}

EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedAlias UnresolvedFunction UnresolvedStar Alias Literal "
    "And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual "
    "Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive "
    "Cast TryCast CaseWhen If In InSubquery ListQuery Exists ScalarSubquery IsNull IsNotNull Between UnresolvedBetween "
    "Like ILike LikeAll LikeAny RLike SortOrder "
    "WindowExpression WindowSpecDefinition WindowSpecReference UnresolvedWindowExpression SpecifiedWindowFrame UnspecifiedFrame CurrentRow UnboundedPreceding UnboundedFollowing "
    "Rollup Cube GroupingSets Extract StringTrim StringTrimLeft StringTrimRight Substring CurrentDate CurrentTimestamp Overlay "
    "TimestampAdd TimestampDiff BoundReference UnresolvedOrdinal SubstringIndex StringPosition StringLocate Position Concat".split()
)

AGGREGATES = frozenset(
    "count sum avg mean min max any_value first first_value last last_value stddev stddev_pop stddev_samp variance var_pop var_samp "
    "median percentile percentile_cont percentile_disc percentile_approx approx_percentile approx_count_distinct count_if bool_and bool_or every some "
    "corr covar_pop covar_samp skewness kurtosis max_by min_by mode listagg string_agg collect_list collect_set array_agg try_sum try_avg".split()
)
#: Repeating a row changes nothing about these.
UNMOVED = frozenset("min max any_value first first_value last last_value bool_and bool_or every some approx_count_distinct collect_set max_by min_by".split())

#: They keep every value of a group; of a whole table that is without bound.
GATHERING = frozenset("listagg string_agg collect_list collect_set array_agg".split())

WINDOW_ONLY = frozenset("row_number rank dense_rank percent_rank cume_dist ntile lag lead nth_value".split())

FUNCTIONS = (
    AGGREGATES
    | WINDOW_ONLY
    | frozenset(
        # numbers
        "abs ceil ceiling floor round bround sign signum sqrt cbrt exp ln log log2 log10 pow power mod pmod greatest least trunc "
        "sin cos tan asin acos atan atan2 degrees radians try_add try_subtract try_multiply try_divide width_bucket "
        # text
        "lower lcase upper ucase trim ltrim rtrim btrim length char_length character_length len concat concat_ws substr substring left right replace translate "
        "instr locate position initcap reverse split_part regexp_replace regexp_extract regexp_like startswith endswith contains like ilike rlike ascii chr "
        "overlay substring_index soundex levenshtein "
        # dates
        "date date_trunc trunc year quarter month week weekofyear day dayofmonth dayofweek dayofyear weekday hour minute second extract date_part datepart "
        "date_add dateadd date_sub datediff date_diff timestampdiff add_months months_between last_day next_day make_date to_date to_timestamp to_timestamp_ntz try_to_date try_to_timestamp date_format "
        "current_date current_timestamp now unix_timestamp unix_date "
        # choice and null
        "coalesce nullif ifnull nvl nvl2 if case when isnull isnotnull isnan nanvl "
        # casts by name
        "int bigint double float decimal string boolean timestamp smallint tinyint cast try_cast "
        # grouping
        "grouping grouping_id".split()
    )
)
