"""User-agent based device classification (first matching rule wins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device labels and the literal tests that produce them.
IPAD = "iPad"
IPHONE = "iPhone"
ANDROID_SMARTPHONE = "Android - Smartphone"
ANDROID_TABLET = "Android - Tablet"
APP_ANDROID = "App - Android"
APP_APPLE = "App - Apple"
DESKTOP = "Desktop"
MOBILE_OTHER = "Mobile - Other"

SMARTPHONE = "Smartphone"
TABLET = "Tablet"

DEVICE_TYPES_KEPT = (IPAD, IPHONE, ANDROID_SMARTPHONE, ANDROID_TABLET, DESKTOP)


def classify_device(device_family: str = "ua_device_family", os_family: str = "ua_os_family",
                    browser_family: str = "ua_browser_family", useragent: str = "useragent",
                    display_env: str = "display_env") -> Column:
    dev, os_, br = F.col(device_family), F.col(os_family), F.col(browser_family)
    ua, env = F.col(useragent), F.col(display_env)
    return (
        F.when(dev == "iPad", F.lit(IPAD))
        .when(dev == "iPhone", F.lit(IPHONE))
        .when((os_ == "Android") & F.lower(ua).like("%mobile%"), F.lit(ANDROID_SMARTPHONE))
        .when(os_ == "Android", F.lit(ANDROID_TABLET))
        # lower-case 'other' here, capitalised 'Other' in the desktop rule
        .when((br == "other") & (env == "app_android"), F.lit(APP_ANDROID))
        .when((br == "other") & (env == "app_ios"), F.lit(APP_APPLE))
        .when((F.lower(br) == "safari") | (dev == "Other") | dev.isNull() | (dev == "Unknown"),
              F.lit(DESKTOP))
        .otherwise(F.lit(MOBILE_OTHER))
    )


def collapse_device(device_type: Column | str = "device_type") -> Column:
    d = F.col(device_type) if isinstance(device_type, str) else device_type
    return (F.when(d.isin(IPHONE, ANDROID_SMARTPHONE), F.lit(SMARTPHONE))
            .when(d.isin(IPAD, ANDROID_TABLET), F.lit(TABLET))
            .otherwise(F.lit(DESKTOP)))
