"""Question wording -> topic, by survey year.

One rule is ``(years, file pattern, header pattern, topic)``. A rule applies to a
header when the year is listed, the file name contains the file pattern and the
lower-case header matches the header pattern. Rules are listed in the order in
which they apply; the first match wins, because a renamed header no longer
carries its old wording.
"""

Y2010 = (2010,)
Y2011_2012 = (2011, 2012)
Y2013_2017 = (2013, 2014, 2015, 2016, 2017)
Y2014_2016 = (2014, 2015, 2016)
Y2018_2020 = (2018, 2019, 2020)

TARGET_RULES = (
    (Y2010, "", "9\\.6.*target type", "active_target"),
    (Y2010, "", "9\\.3.*forecast", "why_no_target"),
    (Y2010, "", "9\\.7.*describe.*actions", "initiative_details"),
    (Y2010, "", "9\\.7.*timescale", "payback_period"),
    (Y2010, "", "9\\.8.*explain why not", "why_no_initiatives"),
    (Y2011_2012 + Y2013_2017, "", "3.1.*target.*active", "active_target"),
    (Y2011_2012 + Y2013_2017, "", "3\\.1a\\.\\s*scope", "absolute_target_scope"),
    (Y2011_2012 + Y2013_2017, "", "3\\.1a.*\\- scope", "absolute_target_scope"),
    (Y2011_2012 + Y2013_2017, "", "3.1a.*science-based", "science_based_absolute_target"),
    (Y2011_2012 + Y2013_2017, "", "(?s)3\\.1a.*comment", "absolute_target_comment"),
    (Y2011_2012 + Y2013_2017, "", "3\\.1b\\.\\s*scope", "intensity_target_scope"),
    (Y2011_2012 + Y2013_2017, "", "3\\.1b.*\\- scope", "intensity_target_scope"),
    (Y2011_2012 + Y2013_2017, "", "3.1b.*science-based", "science_based_intensity_target"),
    (Y2011_2012 + Y2013_2017, "", "3.1b.*comment", "intensity_target_comment"),
    (Y2011_2012 + Y2013_2017, "", "(?s)3\\.1.*why.*forecast", "why_no_target"),
    (Y2011_2012 + Y2013_2017, "", "3.3.*reduction initiatives.*active", "reduction_initiatives"),
    (Y2011_2012 + Y2013_2017, "", "(?s)3\\.3.*please explain why not", "why_no_initiatives"),
    (Y2011_2012 + Y2013_2017, "", "3.3.*activity type", "initiative_type"),
    (Y2011_2012 + Y2013_2017, "", "3.3.*payback period", "payback_period"),
    (Y2011_2012 + Y2013_2017, "", "3.3.*description of activity", "initiative_details"),
    (Y2018_2020, "", "primary activity", "primary_activity"),
    (Y2018_2020, "", "c4.1.*target.*active", "active_target"),
    (Y2018_2020, "", "c4\\.1a.*\\- scope", "absolute_target_scope"),
    (Y2018_2020, "", "c4.1a.*science-based target", "science_based_absolute_target"),
    (Y2018_2020, "", "c4.1a.*detail.*absolute.*explain", "absolute_target_comment"),
    (Y2018_2020, "", "c4\\.1b.*\\- scope", "intensity_target_scope"),
    (Y2018_2020, "", "c4.1b.*science-based target", "science_based_intensity_target"),
    (Y2018_2020, "", "c4.1b.*detail.*intensity.*explain", "intensity_target_comment"),
    (Y2018_2020, "", "c4.1c.*please explain", "why_no_target"),
    (Y2018_2020, "", "c4.3.*did you have", "reduction_initiatives"),
    (Y2018_2020, "", "c4.3d.*why did you not have", "why_no_initiatives"),
    (Y2018_2020, "", "c4.3b.*details.*type$", "initiative_type"),
    (Y2018_2020, "", "c4.3b.*payback period", "payback_period"),
    (Y2018_2020, "", "c4.3b.*details.*comment", "initiative_details"),
)

EMISSION_RULES = (
    # 2010
    (Y2010, "emissions 18", "further information", "verification_standard"),
    (Y2010, "emissions 18", "19.1.*absolute.*vary significantly.*previous year", "change_dir"),
    (Y2010, "emissions 18", "19.2. please explain why they have varied and why the variation is significant.", "change_reason"),
    (Y2010, "20.1a", "20.1c1. scope 1 \\(q12.1\\)", "verification_s1_percent"),
    (Y2010, "20.1a", "20.1c2. scope 2 \\(q13.1\\)", "verification_s2_percent"),
    (Y2010, "20.1a", "20.1c3. scope 3 \\(q15.1\\)", "verification_s3_percent"),
    (Y2010, "emissions 12", "reporting periodfrom", "scope1_which_year"),
    (Y2010, "emissions 13", "reporting periodfrom", "scope2_which_year"),
    (Y2010, "", "12.1.*gross global scope 1", "scope1"),
    (Y2010, "", "13.1.*gross global scope 2", "scope2"),
    (Y2010, "", "15.1c2. metric tonnes of co2-e", "scope3"),
    (Y2010, "", "15.1. please provide data on sources of scope 3 emissions that are relevant to your organization.", "scope3_which_category"),
    (Y2010, "", "10.3.*source$", "excluded_sources"),
    (Y2010, "", "10.3.*why the source is excluded", "excluded_reason"),
    # 2011-2012
    (Y2011_2012, "8.6b", "further details of the verification", "verification_quality"),
    (Y2011_2012, "8.6b", "relevant standard", "verification_standard"),
    (Y2011_2012, "emissions 8", "proportion of your scope 1 emissions that are verified", "verification_s1_percent"),
    (Y2011_2012, "emissions 8", "proportion of your scope 2 emissions that are verified", "verification_s1_percent"),
    (Y2011_2012, "", "13.1a.*direction of change", "change_dir"),
    (Y2011_2012, "", "13.1a.*emissions value", "change_%"),
    (Y2011_2012, "", "13.1a.*reason", "change_reason"),
    (Y2011_2012, "", "13.1a.*comment", "change_detail"),
    (Y2011_2012, "emissions 8", "reporting periodfrom", "scope1_which_year"),
    (Y2011_2012, "emissions 8", "boundary you are using.*scope 1", "scope1_boundary"),
    (Y2011_2012, "", "8.2a.*gross global scope 1.*metric tonnes", "scope1"),
    (Y2011_2012, "", "8.3a.*metric tonnes co2e", "scope2"),
    (Y2011_2012, "", "13.2.*intensity figure", "intensity"),
    (Y2011_2012, "", "13.2.*reason for change", "change_reason_intensity"),
    (Y2011_2012, "8.4a.*2", "8.4a. source$", "excluded_sources"),
    (Y2011_2012, "8.4a.*2", "8.4a.*why the source is excluded", "excluded_reason"),
    # 2013-2017
    ((2013,), "8.6b", "further details of the verification", "verification_quality"),
    ((2013,), "8.6b", "relevant standard", "verification_standard"),
    (Y2014_2016, "8.6a", "further details of the verification", "verification_s1_quality"),
    (Y2014_2016, "8.6a", "relevant standard", "verification_s1_standard"),
    (Y2014_2016, "8.6a", "proportion of reported scope 1", "verification_s1_percent"),
    (Y2014_2016, "8.7a", "further details of the verification", "verification_s2_quality"),
    (Y2014_2016, "8.7a", "relevant standard", "verification_s2_standard"),
    (Y2014_2016, "8.7a", "proportion of reported scope 2", "verification_s2_percent"),
    ((2017,), "8.6a", "type of verification or assurance", "verification_s1_quality"),
    ((2017,), "8.6a", "relevant standard", "verification_s1_standard"),
    ((2017,), "8.6a", "proportion of reported scope 1 emissions verified", "verification_s1_percent"),
    ((2017,), "8.7a", "type of verification or assurance", "verification_s2_quality"),
    ((2017,), "8.7a", "relevant standard", "verification_s2_standard"),
    ((2017,), "8.7a", "proportion of reported scope 1 emissions verified", "verification_s2_percent"),
    (Y2013_2017, "", "12.1a.*direction of change", "change_dir"),
    (Y2013_2017, "", "12.1a.*emissions value", "change_%"),
    (Y2013_2017, "", "12.1a.*reason$", "change_reason"),
    ((2013, 2014, 2015), "12.1a", "12.1a.*comment", "change_detail"),
    ((2016, 2017), "12.1a", "12.1a.*explain and include calculation", "change_detail"),
    ((2013, 2014, 2015), "cc8.*emissions|cc8.1|8.csv", "reporting periodfrom", "scope1_which_year"),
    ((2013, 2014, 2015), "cc8.*emissions|cc8.1|8.csv", "boundary you are using.*scope 1", "scope1_boundary"),
    ((2016,), "cc8.1", "reporting periodfrom", "scope1_which_year"),
    ((2016,), "cc8.1", "boundary you are using.*scope 1", "scope1_boundary"),
    ((2016,), "8.3a", "reporting periodfrom", "scope2_which_year"),
    ((2017,), "cc8.*emissions", "accounting_year", "scope1_which_year"),
    ((2017,), "cc8.*emissions", "boundary you are using.*scope 1", "scope1_boundary"),
    ((2017,), "8.3", "accounting_year", "scope2_which_year"),
    (Y2013_2017, "", "8.2.*gross global scope 1.*metric tonnes co2e", "scope1"),
    ((2013, 2014, 2015), "", "8.3.*gross global scope 2", "scope2"),
    (Y2013_2017, "", "8.3.*scope 2.*location", "scope2_loc"),
    (Y2013_2017, "", "8.3.*scope 2.*market", "scope2_market"),
    (Y2013_2017, "", "8.4a.*why the source is excluded", "excluded_reason"),
    ((2013,), "8.4a", "8.4a. source$", "excluded_sources"),
    ((2014, 2015, 2016, 2017), "8.4a", "8.4a.*details.*sources.*not included.*source", "excluded_sources"),
    # 2018-2020
    ((2018, 2019), "10.1a", "type of verification or assurance", "verification_quality"),
    ((2018, 2019), "10.1a", "relevant standard", "verification_standard"),
    ((2018, 2019), "10.1a", "proportion of reported emissions verified", "verification_percent"),
    ((2020,), "10.1a", "type of verification or assurance", "verification_s1_quality"),
    ((2020,), "10.1a", "relevant standard", "verification_s1_standard"),
    ((2020,), "10.1a", "proportion of reported emissions verified", "verification_s1_percent"),
    ((2020,), "10.1b", "type of verification or assurance", "verification_s2_quality"),
    ((2020,), "10.1b", "relevant standard", "verification_s2_standard"),
    ((2020,), "10.1b", "proportion of reported emissions verified", "verification_s2_percent"),
    ((2020,), "10.1c", "type of verification or assurance", "verification_s3_quality"),
    ((2020,), "10.1c", "relevant standard", "verification_s3_standard"),
    ((2020,), "10.1c", "proportion of reported emissions verified", "verification_s3_percent"),
    (Y2018_2020, "7.9a", "rowname", "change_reason"),
    (Y2018_2020, "7.9a", "7.9a.*change in emissions", "change_mtco2e"),
    (Y2018_2020, "7.9a", "7.9a.*direction of change", "change_dir"),
    (Y2018_2020, "7.9a", "7.9a.*emissions value", "change_%"),
    (Y2018_2020, "7.9a", "7.9a.*please explain calculation", "change_detail"),
    (Y2018_2020, "6.1", "rowname", "scope1_which_year"),
    (Y2018_2020, "6.1", "6.1.*- gross global scope 1.*metric.*co2e", "scope1"),
    (Y2018_2020, "6.3", "rowname", "scope2_which_year"),
    (Y2018_2020, "6.3", "6.3.*- scope 2.*location", "scope2_loc"),
    (Y2018_2020, "6.3", "6.3.*- scope 2.*market", "scope2_market"),
    (Y2018_2020, "6.5", "rowname", "scope3_which_category"),
    (Y2018_2020, "6.5", "6.5.*scope 3.*metric.*co2e", "scope3"),
    (Y2018_2020, "6.4a", "6.4a.*details.*- source$", "excluded_sources"),
    (Y2018_2020, "6.4a", "6.4a.*why the source is excluded", "excluded_reason"),
)

# Header synonyms of the summary sheet, any year, in order.
SUMMARY_RULES = tuple((None, "", pattern, topic) for pattern, topic in (
    ("organization", "name"),
    ("organisation", "name"),
    ("company name", "name"),
    ("account_name", "name"),
    ("account no", "account no"),
    ("account number", "account no"),
    ("account_id", "account no"),
    ("secondary_expansion", "secondary expansions"),
    ("incorporated_country", "country"),
    ("submitted_date", "submitted date"),
    ("response_received_date", "submitted date"),
    ("response received date", "submitted date"),
    ("response_status", "status"),
    ("invitation status", "status"),
    ("^ticker$", "ticker"),
    ("^isin$", "isin"),
    ("^access$", "public"),
    ("^gri$", "primary industry"),
    ("^industry group$", "primary industry"),
))

# Duplicate-column merge: canonical header names.
COALESCE_RULES = tuple((None, "", pattern, topic) for pattern, topic in (
    ("^ticker$", "ticker"),
    ("^isin$", "isin"),
    ("^account number$", "account no"),
    ("^organization$", "name"),
    ("^access$", "public"),
))

# Canonical keys: only the first matching header by position is taken, except
# for the country, where every match is.
KEY_HEADERS = (
    ("account no", "account", True),
    ("name", "account_name|organisation|organization|company name", True),
    ("country", "country", False),
)
