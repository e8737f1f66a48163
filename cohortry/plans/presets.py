"""Fixed values that the published analyses use.  All operators take them as parameters."""

# Lines of business counted, and the claim status of a paid claim.
LINES_OF_BUSINESS = ("US", "BH", "BC", "BX", "HA")
PAID_STATUS = ("1",)
MIN_FILLS = 4
COMPLIANT_AT = 80

# Therapy trees by class number - roots, branches and leaves left out.
DIABETIC_ROOTS = (154, 5886)
CARDIOVASCULAR_ROOTS = (2553,)
CARDIOVASCULAR_NOT_PARENTS = (216, 201, 205, 259, 1257, 3609, 5955, 6228, 6929, 3886)
CARDIOVASCULAR_NOT_NODES = (6022, 6186, 2720, 2721, 2708, 264, 265, 2783, 6903, 4549, 6430, 6551)
CENTRAL_NERVOUS_ROOTS = (6721,)

# Upper edges (days before the prediction date) and names of donation buckets.
BUCKET_EDGES = (-1825, -1460, -1095, -730, -365, 0)
BUCKET_LABELS = ("donation_historical", "donation_p5yr", "donation_p4yr", "donation_p3yr", "donation_p2yr", "donation_p1yr")
KEPT_BUCKETS = ("donation_p2yr", "donation_p5yr", "donation_historical")
FIRST_YEAR = 1950

# A loan of at most 80 % of the property is ideal; a major donor gives 20,000.
IDEAL_LOAN_TO_VALUE = 0.80
MAJOR_DONOR_AMOUNT = 20000
PROPERTY_COLUMNS = ("totalHouseholdDebt", "primaryPropertyLoanToValue", "primaryPropertyValue", "propertyCount", "NetWorth")

# Class order of the probability columns; states that are not usable.
RACE_COLUMNS = ("pred_whi", "pred_bla", "pred_his", "pred_asi", "pred_oth")
RACE_NAMES = ("white", "black", "hispanic", "asian", "other")
BAD_STATES = ("??", "VI")

# Engagement levels from lowest to highest.
ENGAGEMENT_LEVELS = ("Low", "Medium", "High")
