"""Fixed values of the jobs' rules; every job takes them as parameters with these as defaults."""

STATUSES = ("New Idea", "Assigned", "WIP", "UAT", "Completed", "Hold/Park", "Rejected")
ACTIVE = ("Assigned", "WIP", "UAT", "Hold/Park")
CUSTOMER, INTERNAL = "Customer Requirement", "Internal"
AUTOMATION = ("Automation-Personal Productivity", "Automation-Process Improvement", "Automation-Defined Product and Sales", "Automation-Quality Enhancement")
AI = ("AI-Personal Productivity", "AI-Process Improvement", "AI-Defined Product and Sales")
FREQUENCY = {"Daily": 260, "Weekly": 52, "Monthly": 12, "Yearly": 1}
REJECTIONS = ("Technical Rejection", "Business Rejection")
REGIONS = ("ASIA", "EUROPE", "AFRICA", "AMERICA")
FREE_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "rediff.com", "outlook.com", "live.com", "icloud.com", "aol.com", "protonmail.com", "yandex.com", "mail.com", "zoho.com", "gmx.com", "inbox.com")
#: Kind of meeting, date column, time of day.
MEETINGS = (("vsm", "vsm_meeting_date", "10:00"), ("sprint", "sprint_meeting_date", "11:00"), ("delivery", "delivery_date", "15:00"))
