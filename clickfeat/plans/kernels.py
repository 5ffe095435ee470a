"""The three feature sets of the original scripts, as data.

Fixed values: every key list, value column and output name below must equal
the original for the same features; they are listed in the original order.
"""

from __future__ import annotations

from ..operators.aggregates import Agg
from .specs import CumCount, Gap, InTestHH, NextClick, Shift

RAW_PREDICTORS_1 = ["app", "device", "os", "channel", "hour"]
CATEGORICAL_1 = ["app", "device", "os", "channel", "hour", "os_device_app_channel_by_hour_countuniq"]

# Kernel 1: 30 derived features over train and test supplement.
KERNEL1 = [
    Gap(("ip", "app", "device", "os", "channel")),
    Gap(("ip", "os", "device")),
    Gap(("ip", "os", "device", "app")),
    Gap(("ip", "os", "device", "channel")),
    Gap(("ip", "os", "device", "app", "hour")),
    Gap(("ip", "os", "device", "channel", "hour")),
    Gap(("device",)),
    Gap(("device", "channel")),
    Gap(("app", "device", "channel")),
    Gap(("device", "hour")),
    Gap(("ip", "channel"), direction="prev"),
    Agg("nunique", ("ip",), "channel"),
    Agg("nunique", ("ip", "device", "os"), "app"),
    Agg("mean", ("ip", "device", "os"), "app"),
    Agg("nunique", ("ip", "day"), "hour"),
    Agg("nunique", ("ip",), "app"),
    Agg("nunique", ("ip", "app"), "os"),
    Agg("nunique", ("ip",), "device"),
    Agg("nunique", ("app",), "channel"),
    CumCount(("ip",), "os"),
    CumCount(("ip", "device", "os"), "app"),
    Agg("count", ("ip", "day", "hour")),
    Agg("count", ("ip", "app")),
    Agg("count", ("ip", "app", "os")),
    Agg("var", ("ip", "day", "channel"), "hour"),
    Agg("var", ("ip", "app", "os"), "hour"),
    Agg("var", ("ip", "app", "channel"), "day"),
    Agg("mean", ("ip", "app", "channel"), "hour"),
    Agg("mean", ("os", "device", "app", "channel"), "hour"),
    Agg("nunique", ("os", "device", "app", "channel"), "hour"),
]

RAW_PREDICTORS_2 = ["app", "device", "os", "channel", "hour"]
CATEGORICAL_2 = ["app", "device", "os", "channel", "hour"]

# Kernel 2: 18 derived features over train and test.
KERNEL2 = [
    Gap(("ip", "app", "device", "os", "channel")),
    Gap(("ip", "os", "device")),
    Gap(("ip", "os", "device", "app")),
    Gap(("ip", "channel"), direction="prev"),
    Gap(("ip", "os"), direction="prev"),
    Agg("nunique", ("ip",), "channel"),
    Agg("nunique", ("ip", "device", "os"), "app"),
    Agg("nunique", ("ip", "day"), "hour"),
    Agg("nunique", ("ip",), "app"),
    Agg("nunique", ("ip", "app"), "os"),
    Agg("nunique", ("ip",), "device"),
    Agg("nunique", ("app",), "channel"),
    CumCount(("ip",), "os"),
    CumCount(("ip", "device", "os"), "app"),
    Agg("count", ("ip", "day", "hour")),
    Agg("count", ("ip", "app")),
    Agg("count", ("ip", "app", "os")),
    Agg("var", ("ip", "app", "os"), "hour"),
]

RAW_PREDICTORS_3 = ["app", "device", "os", "channel", "hour", "day"]
CATEGORICAL_3 = ["app", "device", "os", "channel", "hour", "day"]

# Kernel 3: X0-X8 (key = all columns but the last), next click and its
# shift, and the named features.
KERNEL3 = [
    Agg("nunique", ("ip",), "channel", "X0"),
    CumCount(("ip", "device", "os"), "app", "X1"),
    Agg("nunique", ("ip", "day"), "hour", "X2"),
    Agg("nunique", ("ip",), "app", "X3"),
    Agg("nunique", ("ip", "app"), "os", "X4"),
    Agg("nunique", ("ip",), "device", "X5"),
    Agg("nunique", ("app",), "channel", "X6"),
    CumCount(("ip",), "os", "X7"),
    Agg("nunique", ("ip", "device", "os"), "app", "X8"),
    NextClick(("ip", "app", "device", "os"), "nextClick"),
    Shift("nextClick", "nextClick_shift"),
    Agg("nonnull", ("ip", "day", "hour"), "channel", "ip_tcount"),
    Agg("nonnull", ("ip", "app"), "channel", "ip_app_count"),
    Agg("nonnull", ("ip", "app", "os"), "channel", "ip_app_os_count"),
    InTestHH("in_test_hh"),
    Agg("nonnull", ("app",), "channel", "app_count"),
    Agg("nonnull", ("os", "app"), "channel", "os_app_count"),
    Agg("nunique", ("ip",), "device", "ip_unique_device"),
    Agg("nunique", ("os",), "device", "os_unique_device"),
    Agg("nunique", ("ip",), "app", "ip_unique_app"),
    Agg("nunique", ("ip", "device", "os"), "app", "ip_device_os_unique_app"),
    Agg("nunique", ("wday", "hour"), "app", "wday_hour_unique_app"),
    Agg("nunique", ("ip", "app"), "os", "ip_app_unique_os"),
    Agg("nunique", ("ip", "wday"), "in_test_hh", "ip_wday_unique_in_test_hh"),
    Agg("nunique", ("ip", "day"), "hour", "ip_day_unique_hour"),
    Agg("nunique", ("ip", "wday"), "hour", "ip_wday_unique_hour"),
    Agg("nunique", ("ip", "os", "wday"), "hour", "ip_os_wday_unique_hour"),
    Agg("nunique", ("ip", "app", "wday"), "hour", "ip_app_wday_unique_hour"),
    Agg("nunique", ("ip", "device", "wday"), "hour", "ip_device_wday_unique_hour"),
    Agg("var", ("ip", "day", "channel"), "hour", "ip_tchan_count"),
    Agg("var", ("ip", "app", "os"), "hour", "ip_app_os_var"),
    Agg("var", ("ip", "app", "channel"), "day", "ip_app_channel_var_day"),
    Agg("mean", ("ip", "app", "channel"), "hour", "ip_app_channel_mean_hour"),
    CumCount(("ip",), "os", "ip_cum_os"),
    CumCount(("ip", "device", "os"), "app", "ip_device_os_cum_app"),
]

# Categoricals of hundreds or thousands of values enter the matrix by their out-of-fold rate, the others as codes.
RATES = ("app", "device", "os", "channel")

# Predictor list of kernel 3 in its original order.
PREDICTORS_3 = [
    "nextClick", "nextClick_shift",
    "app", "device", "os", "channel", "hour", "day",
    "ip_tcount", "ip_tchan_count", "ip_app_count",
    "ip_app_os_count", "ip_app_os_var",
    "ip_app_channel_var_day", "ip_app_channel_mean_hour",
    "in_test_hh", "ip_wday_unique_in_test_hh", "ip_device_os_unique_app", "ip_unique_device",
    "ip_unique_app", "ip_app_unique_os", "ip_day_unique_hour",
    "ip_cum_os", "ip_device_os_cum_app", "ip_wday_unique_hour",
    "ip_os_wday_unique_hour", "ip_app_wday_unique_hour", "ip_device_wday_unique_hour",
    "os_app_count", "app_count", "os_unique_device", "wday_hour_unique_app",
    "X0", "X1", "X2", "X3", "X4", "X5", "X6", "X7", "X8",
]

FEATURE_SETS = {"kernel1": KERNEL1, "kernel2": KERNEL2, "kernel3": KERNEL3}


def predictors(name: str) -> list[str]:
    """Model input columns of a feature set, in the original order."""
    from .specs import spec_name

    if name == "kernel3":
        return list(PREDICTORS_3)
    specs = FEATURE_SETS[name]
    raw = RAW_PREDICTORS_1 if name == "kernel1" else RAW_PREDICTORS_2
    derived = [spec_name(s) for s in specs]
    return derived + [r for r in raw if r not in derived]
