"""What the test catalogue takes as given about flows, endpoints and connectors."""

from __future__ import annotations

# Every known flow and the endpoint that it calls.
FLOW_ENDPOINTS = (
    ("PaymentIntent", "POST", "/payments"),
    ("PaymentIntentOffSession", "POST", "/payments"),
    ("PaymentIntentWithShippingCost", "POST", "/payments"),
    ("ZeroAuthPaymentIntent", "POST", "/payments"),
    ("ZeroAuthMandate", "POST", "/payments"),
    ("MITAutoCapture", "POST", "/payments"),
    ("MITManualCapture", "POST", "/payments"),
    ("SaveCardConfirmAutoCaptureOffSession", "POST", "/payments"),
    ("SaveCardConfirmManualCaptureOffSession", "POST", "/payments"),
    ("SaveCardConfirmAutoCaptureOffSessionWithoutBilling", "POST", "/payments"),
    ("ManualRetryPaymentEnabled", "POST", "/payments"),
    ("ManualRetryPaymentDisabled", "POST", "/payments"),
    ("ManualRetryPaymentCutoffExpired", "POST", "/payments"),
    ("Ideal", "POST", "/payments"),
    ("Eps", "POST", "/payments"),
    ("Giropay", "POST", "/payments"),
    ("Sofort", "POST", "/payments"),
    ("Blik", "POST", "/payments"),
    ("Przelewy", "POST", "/payments"),
    ("Ach", "POST", "/payments"),
    ("Pix", "POST", "/payments"),
    ("DuitNow", "POST", "/payments"),
    ("UpiCollect", "POST", "/payments"),
    ("UpiIntent", "POST", "/payments"),
    ("Bluecode", "POST", "/payments"),
    ("CryptoCurrency", "POST", "/payments"),
    ("CryptoCurrencyManualCapture", "POST", "/payments"),
    ("PaymentWithBilling", "POST", "/payments"),
    ("PaymentWithBillingEmail", "POST", "/payments"),
    ("PaymentWithFullName", "POST", "/payments"),
    ("PaymentWithoutBilling", "POST", "/payments"),
    ("Capture", "POST", "/payments/:id/capture"),
    ("PartialCapture", "POST", "/payments/:id/capture"),
    ("Overcapture", "POST", "/payments/:id/capture"),
    ("IncrementalAuth", "POST", "/payments/:id/incremental_authorization"),
    ("Refund", "POST", "/refunds"),
    ("PartialRefund", "POST", "/refunds"),
    ("SyncRefund", "GET", "/refunds/:id"),
    ("VoidAfterConfirm", "POST", "/payments/:id/cancel"),
    ("ZeroAuthConfirmPayment", "POST", "/payments/:id/confirm"),
    ("PaymentConfirmWithShippingCost", "POST", "/payments/:id/confirm"),
    ("SessionToken", "POST", "/payments/session_tokens"),
)

# Flows with an endpoint that specs never look up by name, and those looked up that have no endpoint.
KNOWN_FLOWS = frozenset(f for f, _, _ in FLOW_ENDPOINTS) - {
    "PaymentWithBilling",
    "PaymentWithBillingEmail",
    "PaymentWithFullName",
    "PaymentWithoutBilling",
} | {"No3DSManualCapture", "No3DSAutoCapture"}

# Parts of a test command's name and the flow each stands for, the first that fits counts.
COMMAND_FLOWS = (
    ("incrementalauthorization", "IncrementalAuth"),
    ("overcapture", "Overcapture"),
    ("partialcapture", "PartialCapture"),
    ("capture", "Capture"),
    ("partialrefund", "PartialRefund"),
    ("syncrefund", "SyncRefund"),
    ("refund", "Refund"),
    ("void", "VoidAfterConfirm"),
    ("zeroauthconfirm", "ZeroAuthConfirmPayment"),
    ("zeroauthpaymentintent", "ZeroAuthPaymentIntent"),
    ("mandate", "ZeroAuthMandate"),
    ("mit", "MITAutoCapture"),
    ("createpaymentintent", "PaymentIntent"),
    ("confirm", "PaymentIntent"),
)

# The list that a flow's connectors must be in, or stay out of, if it has one.
FLOW_INCLUDE_LIST = {
    "Overcapture": "INCLUDE.OVERCAPTURE",
    "IncrementalAuth": "INCLUDE.INCREMENTAL_AUTH",
    "ManualRetryPaymentEnabled": "INCLUDE.MANUAL_RETRY",
    "ManualRetryPaymentDisabled": "INCLUDE.MANUAL_RETRY",
    "ManualRetryPaymentCutoffExpired": "INCLUDE.MANUAL_RETRY",
    "MandatesUsingNTIDProxy": "INCLUDE.MANDATES_USING_NTID_PROXY",
    "DDCRaceConditionClientSide": "INCLUDE.DDC_RACE_CONDITION",
    "DDCRaceConditionServerSide": "INCLUDE.DDC_RACE_CONDITION",
    "PaymentWebhook": "INCLUDE.PAYMENTS_WEBHOOK",
}
FLOW_EXCLUDE_LIST = {"ConnectorAgnosticNTID": "EXCLUDE.CONNECTOR_AGNOSTIC_NTID"}

# The connectors' names.
CONNECTORS = (
    "Aci",
    "Adyen",
    "Airwallex",
    "Archipel",
    "Authipay",
    "Authorizedotnet",
    "Bambora",
    "Bamboraapac",
    "BankOfAmerica",
    "Barclaycard",
    "Billwerk",
    "Bluesnap",
    "Braintree",
    "Calida",
    "Cashtocode",
    "Celero",
    "Checkbook",
    "Checkout",
    "Cryptopay",
    "Cybersource",
    "Datatrans",
    "Deutschebank",
    "Dlocal",
    "Elavon",
    "Facilitapay",
    "Finix",
    "Fiserv",
    "Fiservemea",
    "Fiuu",
    "Forte",
    "Getnet",
    "Gigadat",
    "Globalpay",
    "Hipay",
    "Iatapay",
    "ItauBank",
    "Jpmorgan",
    "Loonio",
    "Mollie",
    "Moneris",
    "Multisafepay",
    "Nexinets",
    "Nexixpay",
    "Nmi",
    "Noon",
    "Novalnet",
    "Nuvei",
    "Paybox",
    "Payload",
    "Paypal",
    "Paysafe",
    "Payu",
    "Peachpayments",
    "PowerTranz",
    "Redsys",
    "Shift4",
    "Silverflow",
    "Square",
    "Stax",
    "Stripe",
    "Tesouro",
    "Trustpay",
    "TrustPayments",
    "Tsys",
    "Volt",
    "WellsFargo",
    "WorldPay",
    "Worldpayvantiv",
    "Worldpayxml",
    "Xendit",
    "Zift",
)
#: Each by its name in small letters.
CONNECTOR_NAMES = {c.lower(): c for c in CONNECTORS}
