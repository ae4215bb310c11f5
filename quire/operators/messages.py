"""What the rules say, as templates by key. {places} are filled from a row's map."""

from __future__ import annotations

# The wording of the determinations, in the rules' order.
MESSAGES = {
    # funding
    "funding:none": "This {amount} purchase uses no federal funds, so UC/State rules (BUS-43, CA Public Contract Code) apply.",
    "funding:federal": "This {amount} purchase is fully funded by a {award_label}, so federal requirements ({requirements}) apply in addition to UC policy.",
    "funding:mixed_federal": "Mixed funding: {federal} federal + {other} non-federal. Because the federal portion meets the {trigger} {award_label} threshold, federal requirements apply to the ENTIRE {amount} transaction, not just the federal portion (SSPR form Rev. 12-2025, Section I: check Federal side only).",
    "funding:mixed_other": "Mixed funding: {federal} federal + {other} non-federal. Because the federal portion is below the {trigger} {award_label} threshold, only UC/State rules apply to the transaction (SSPR form Rev. 12-2025, Section I).",
    # value
    "basis:total": "total anticipated value over {years} years (federal rules use anticipated contract value)",
    "basis:annual": "annual expenditure (BUS-43 uses annual value; {years}-year total {aggregate})",
    "basis:combined": "combined value of related orders",
    "basis:purchase": "purchase value",
    # thresholds
    "note:over": "At {value} ({basis}), this meets/exceeds the $100,000 competitive bid threshold.",
    "note:under": "At {value} ({basis}), this is below the $100,000 competitive bid threshold.",
    "note:exempt": "Competitive bid exemption applies: {exemption}.",
    "note:federal": "The federal bid threshold for UC is also $100,000: CA Public Contract Code is stricter than the $350,000 federal Simplified Acquisition Threshold, and the stricter rule applies.",
    "note:whole_term": "Note: under Uniform Guidance/FAR the {aggregate} total would require a bid; BUS-43 only compels a bid for annual expenditures of $100,000 or more. Seeking competition is still encouraged.",
    "note:quote": "Small business/DVBE: obtain 1 quote from certified small businesses/DVBEs (BUS-43: 1 quote for $10K-$100K, 2 quotes above $100K up to the $250K ceiling).",
    "note:quotes": "Small business/DVBE: obtain 2 quotes from certified small businesses/DVBEs (BUS-43: 1 quote for $10K-$100K, 2 quotes above $100K up to the $250K ceiling).",
    "note:form": "SSPR form threshold for {form_label} purchases is {form_threshold}: SSPR IS required.",
    "note:no_form": "SSPR form threshold for {form_label} purchases is {form_threshold}: SSPR is NOT required.",
    "note:micro": "(Campuses may set a grant/cooperative agreement micro-purchase threshold up to $50,000, per OMB guidance.)",
    "exemption:sole_source": "sole source (with allowable SSPR Section IV justification)",
    "exemption:small_business": "certified small business / DVBE (under $250,000)",
    "exemption:professional_services": "professional/personal services (non-federal only)",
    "exemption:urgent": "unusual & compelling urgency (non-federal only)",
    # flags
    "SPLIT_ORDER:competitive_bid": "Potential split order: {orders} = {total}. Each order is below the $100,000 competitive bid threshold but together they meet it. Requirements must not be artificially divided to avoid competition; treat this as one {total} procurement.",
    "SPLIT_ORDER:form": "Potential split order: {orders} = {total}. Each order is below the {order_form} SSPR form threshold but together they meet it. Requirements must not be artificially divided to avoid competition; treat this as one {total} procurement.",
    "SPLIT_ORDER:intent": "Intentionally dividing a purchase into smaller orders to avoid bidding requirements is prohibited under BUS-43. For reference, the combined value is {total}; the competitive bid threshold is $100,000.",
    "SELECTION_NOT_ALLOWED:professional_services": "Professional/personal services is only available for non-federal funds; it cannot be used when federal rules apply.",
    "SELECTION_NOT_ALLOWED:urgent": "Unusual & compelling urgency is only available for non-federal funds; it cannot be used when federal rules apply.",
    "SOLE_SOURCE_INVALID:pre_work": "Pre-work with the selected supplier to customize the equipment, thereby excluding competition, is not an allowable justification. Allowable justifications: {allowed}.",
    "SOLE_SOURCE_INVALID:price": "Price is not an allowable sole source justification. Allowable justifications: {allowed}.",
    "SOLE_SOURCE_INVALID:brand": "Brand name is not an allowable sole source justification. Allowable justifications: {allowed}.",
    "SOLE_SOURCE_INVALID:familiarity": "Staff familiarity or preference is not an allowable sole source justification; sole source requires that only one supplier can meet the requirement. Allowable justifications: {allowed}.",
    "SOLE_SOURCE_INVALID:geographic": "Geographical preference is not an allowable justification for federal funds. Allowable justifications: {allowed}.",
    "SOLE_SOURCE_INVALID:no_competition": "'No Competition' is only available for federal grant and cooperative agreement funds.",
    "SOLE_SOURCE_INVALID": "'{justification}' is not an allowable sole source justification for this funding. Allowable: {allowed}.",
    "SOLE_SOURCE_JUSTIFICATION": "Sole source must be documented with an allowable justification in SSPR Section IV: {allowed}. Price, brand name, and pre-work with the supplier that excludes competition are NOT allowable.",
    "SB_FEDERAL_OVER_100K": "The SSPR FAQ allows SB/DVBE awards up to $250,000 with any funding source, but the SSPR form's federal Certified Small Business option is limited to purchases under $100,000. Confirm the source selection with Procurement.",
    "SB_LIMIT_EXCEEDED": "At {value} this is not under the $250,000 small business/DVBE limit, so the small business exception does not apply and a competitive bid is required.",
    "SB_CEILING_CONFLICT": 'BUS-43 allows small business/DVBE awards "up to $250,000" but the SSPR form says "Only <$250k"; at exactly $250,000 confirm with Procurement.',
    "CERTIFIED_COST_PRICING": "Sole-sourced federal non-commercial contract order of $2,500,000 or more: the supplier must submit certified cost or pricing data (FAR 15.403-4).",
    "CERTIFIED_COST_PRICING:unknown": "Sole-sourced federal non-commercial contract order of $2,500,000 or more: the supplier must submit certified cost or pricing data (FAR 15.403-4). (Not required if the item is a commercial item.)",
    "FEDERAL_PORTION_BELOW_TRIGGER": "Federal dollars are present but below the {trigger} SSPR federal {award} threshold, so only UC/State procurement rules govern this transaction.",
    "PHI": "Vendor will access protected health information (PHI): a Business Associate Agreement (BAA) is required under HIPAA.",
    "PHI_DEIDENTIFIED": "Only de-identified health information is shared, so a BAA is not required (a BAA applies when a vendor handles PHI).",
    "DATA_SECURITY": "Vendor will access UC institutional data: the Appendix Data Security must be included in the agreement.",
    "IS3": "Vendor provides IT services/software/cloud involving UC data: the engagement must comply with UC IS-3 Electronic Information Security.",
    "BUS79": "Business meetings and entertainment: document business purpose and names of all attendees; meal/entertainment limits apply.",
    "G41": "Employee non-cash awards and gifts are governed by G-41 (limits and eligibility apply).",
    "G13": "Moving and relocation expenses are governed by G-13.",
    "BUS50": "Controlled substances require DEA registration, a Controlled Substances Program Officer (CSPO), and RAPC approval where applicable.",
    "VEHICLE": "University vehicle acquisitions and dispositions are governed by UCPS 120029.",
    "BUS63": "Review the BUS-63 Risk Matrix for the supplier's insurance requirements (e.g., general liability limits).",
    # covered services
    "covered:is": "'{services}' is a covered service under Regents Policy 5402 and AFSCME 3299 Article 5. The University generally prohibits contracting out covered services that can be performed by UC employees.",
    "covered:displaces": "PROHIBITED: the contract would displace UC employees. Displacement (demotion, layoff, or involuntary reduction in time due to the contract) is not permitted under Regents Policy 5402, regardless of contract value.",
    "covered:unknown": "'{exception}' is not a recognized exception; the contract is prohibited unless a listed exception applies.",
    "covered:claimed": "Claimed exception: {exception_label}. Contracting out may be permitted if this exception is documented, and it must not displace UC employees.",
    "covered:none": "Contracting out is permitted ONLY if a listed exception applies: {exceptions}. If none applies, the contract is prohibited.",
    "covered:notice": "At {amount} (over $100,000), AFSCME 3299 must be notified before entering, extending, or renewing the contract: 30 calendar days' notice (if no RFP) or a copy of the RFP at issuance. AFSCME has 14 calendar days to respond.",
    "covered:no_notice": "At {amount} (not over $100,000), AFSCME 3299 advance notice is not required.",
    "covered:parity": "Contract over $100,000 and longer than 90 days (term: {term}): the contractor must provide wages and benefits equivalent to UC employees performing the same work (wage/benefit parity).",
    "covered:no_parity": "Term is 90 days or less, so wage/benefit parity is not required.",
    # equipment
    "tag:yes": "{name} ({cost}): MUST be inventoried, tagged, tracked, and assigned a CAAN - it meets the $5,000 inventorial equipment threshold (BUS-29).",
    "tag:accessory": "{name} ({cost}): MUST be inventoried, tagged, tracked, and assigned a CAAN - it meets the $5,000 inventorial equipment threshold (BUS-29). Accessories of $5,000 or more acquired after the initial purchase must also be capitalized.",
    "tag:no": "{name} ({cost}): does NOT need tagging - it is below the $5,000 threshold and is not inventorial equipment (BUS-29).",
    # the answer's line
    "line:mixed_federal": "Federal rules apply to the entire transaction (federal portion {federal} meets the {trigger} federal {award} threshold).",
    "line:mixed_other": "Federal rules do NOT apply; UC/State rules only (federal portion {federal} is below the {trigger} federal {award} threshold).",
    "line:bid": "Competitive bid required: {bid} ({value}; threshold $100,000{line_exemption}).",
    "line:form": "SSPR required: {form} (threshold {form_threshold}{line_sections}).",
    "line:tag": "{name} ({cost}): must be tagged (BUS-29 threshold $5,000).",
    "line:no_tag": "{name} ({cost}): no tagging required (BUS-29 threshold $5,000).",
    "line:prohibited": "Covered service ({services}) under Regents Policy 5402: PROHIBITED (displaces UC employees). AFSCME notice: {notice}.{line_parity}",
    "line:exception": "Covered service ({services}) under Regents Policy 5402: allowed only under a listed exception. AFSCME notice: {notice}.{line_parity}",
    "line:also": "Also required: {others}.",
    "line:before": "Determination (rule engine): ",
    "context:before": "=== RULE ENGINE DETERMINATION (authoritative - do not override) ===",
    "context:after": "=== END RULE ENGINE DETERMINATION ===",
    "answer:general": "These are the general thresholds. For a determination on a specific purchase, ask with its dollar amount and funding source (federal contract, federal grant, or non-federal).",
    "answer:no_source": "See the policy excerpts cited below.",
    # former employees
    "post_employment:retiree": "Retirees are generally exempt from the two-year and 12-month contracting bans and may be hired back by the University; confirm with the campus conflict-of-interest office.",
    "post_employment:two_years": "PROHIBITED for two years after leaving: the former employee took part in the negotiations, planning or decision-making for this contract while at UC (Public Contract Code; OGC post-employment rules 3(a)).",
    "post_employment:12_months": "PROHIBITED for 12 months after leaving: contracting with the department the former employee left, where they held a policymaking position in the same subject area (OGC post-employment rules 3(b)).",
    "post_employment:representing": "One-year ban applies: for one year after leaving, a former employee may not appear before or communicate with their campus while representing another party for pay to influence a University proceeding.",
    "post_employment:check": "No contracting ban is triggered on the facts given, but check both bans before contracting: two years if the former employee took part in the decision-making for this contract, 12 months if they held a policymaking position in the contracting department; retirees are generally exempt. The project's funding source is irrelevant.",
    "post_employment": "Post-employment contracting bans (Public Contract Code, OGC post-employment rules): (1) TWO YEARS - no contract with the University to provide goods or services if the person took part in any negotiations, planning, arrangements or decision-making for that contract while employed; (2) 12 MONTHS - no contract with the department they left if they held a policymaking position there in the same general subject area; (3) retirees are generally exempt from both bans and may be hired back; (4) the separate ONE-YEAR rule bars representing another party before the University for pay - it is not a contracting ban. The source of the project's funding does not change any of this.",
    "post_employment:ask": "Ask the campus conflict-of-interest office to confirm the person's prior role and whether an exemption applies.",
    # business meals
    "business_meal:documents": "Documentation required for a business meal or entertainment expense (BUS-79): type of expense; type of event; number of participants with a guest list giving each participant's name, title and occupation or group affiliation; date and location; the business-related purpose of the occasion; and the signature, printed name and department of the approving authority (plus the host's signature for entertainment, recruitment and morale-building events). Expenses of $75 or more per occasion need original itemized receipts.",
    "business_meal": "BUS-79 IV.B.1: the reimbursement, recharge or payment request must carry all of the items above; the two that establish the business relationship are the purpose of the occasion and the guest list with names and titles.",
    # tax-free alcohol
    "alcohol_permit:permit": "Tax-free alcohol is bought under the University's TTB permit, held in the name of The Regents: the vendor must have a signed copy of the valid permit on file, inventories are semiannual, and receipts and records are kept for every delivery.",
    "alcohol_permit": "Tax-free alcohol permits (BFB-BUS-2 / UCPS 120031): (1) the application for an industrial use permit is filed with the Alcohol and Tobacco Tax and Trade Bureau (TTB), in the name of The Regents of the University of California; (2) TTB approves it and issues the numbered Permit to Use Alcohol Free of Tax (Form 5150.22), which is continuous unless terminated; (3) no shipment may be made until the vendor has a signed copy of the valid permit on file; (4) a physical inventory is taken semiannually (about every six months); (5) authorized persons sign a receipt for each delivery and keep complete records of all tax-free alcohol received and issued; (6) tax-free alcohol is used only on University premises.",
    "alcohol_permit:dea": "A DEA registration is not the credential for tax-free alcohol; DEA registration governs controlled substances (BUS-50). The tax-free alcohol permit is the TTB permit.",
    "alcohol_permit:scheduled": "Inventories are semiannual, not annual, and an upcoming scheduled inventory does not block withdrawals under the permit in the meantime, provided the last physical inventory was within about six months. The dollar amount of the order is irrelevant.",
    "alcohol_permit:overdue": "The inventory requirement is semiannual, not annual: if the last physical inventory was more than about six months ago it is overdue and should be taken before further withdrawals.",
    "alcohol_permit:leaving": "The permit belongs to The Regents, not to an individual investigator, and is continuous, so a permit holder's retirement or departure does not invalidate it; update the campus's authorized-person list.",
    # risk matrix
    "risk_matrix:high": "High risk under the BUS-63 Risk Matrix ({exposures}): a Certificate of Insurance must be collected before the contract is executed.",
    "risk_matrix:moderate": "Moderate risk under the BUS-63 Risk Matrix (digital risk - moderate): a Certificate of Insurance does not need to be collected, but the agreement must require the contractor to provide one on request.",
    "risk_matrix:low": "Low risk under the BUS-63 Risk Matrix (digital risk - low): a Certificate of Insurance does not need to be collected, but the agreement must require the contractor to provide one on request.",
    "risk_matrix:rule": "Certificate of Insurance rule (BUS-63 Risk Matrix): required whenever the contract involves any High-risk exposure C-K; for Low or Moderate risk (digital risk only) it is not collected but must be available on request.",
    "risk_matrix": "BUS-63 Risk Matrix: exposures C-K (digital risk - high; physical safety or security; professional services; controlled substances / medical devices; international; students or minors; use of UC facilities; financial assets; transportation) make the ENTIRE contract High risk and a Certificate of Insurance (COI) must be collected. Exposure A (digital risk - low) is Low risk and B (digital risk - moderate) is Moderate risk: a COI does not need to be collected, but the agreement or PO must require the contractor to provide one on request. Digital risk: P3/P4 data or a high/critical VRA = high; P2 data, generative AI / third-party analytics, or a moderate VRA = moderate; P1 data or a minimal VRA = low. The local Risk Management office makes the final call.",
    "risk_matrix:limits": "The BUS-63 policy itself does not set dollar minimums; insurance limits are in the UC Terms and Conditions of Purchase (insurance article).",
    # facts, by topic and number
    "bid:1": "Competitive bid required at $100,000 or more (BUS-43: more than $100,000 annually, aggregated per supplier; CA Public Contract Code). The same $100,000 bid threshold applies to federal funds because the CA PCC is stricter than the $350,000 federal Simplified Acquisition Threshold.",
    "sspr:1": "SSPR form required for: federal contract purchases >= $15,000; federal grant/cooperative agreement purchases >= $50,000; non-federal purchases >= $100,000.",
    "sspr:2": "SSPR sections by source selection: competitive bid I, VII, VIII; federal competitive proposals (<$100K, 3 quotes per 2 CFR 200.320(a)(2)(i)) I, II, VII, VIII; federal sole source I, III, IV, VII, VIII; non-federal sole source I, III-VIII; small business/DVBE I, III, VII, VIII; professional/personal services (non-federal) I, III, V, VII, VIII; unusual & compelling urgency (non-federal) I, VI, VII, VIII.",
    "federal:1": "Federal micro-purchase threshold: $15,000; campuses may set up to $50,000 for grants/cooperative agreements (OMB). Simplified Acquisition Threshold: $350,000.",
    "federal:2": "Federally funded orders require the Federal Funds Checklist, Debarment & Suspension verification, Anti-Lobbying (Byrd) verification at $100,000+, and flow-down articles (grants: UC T&C Articles 1, 8.1(c)(i-v), 11.8, 11.9, 11.10; contracts: 8.1(a) or 8.1(b), 1, 11.10).",
    "mixed:1": "Mixed funding: if the federal portion meets the SSPR federal threshold (federal contract >= $15,000; federal grant/cooperative agreement >= $50,000), federal requirements apply to the ENTIRE transaction (check Federal side only); below that, only UC/State rules apply (SSPR form Rev. 12-2025, Section I).",
    "multi_year:1": "Multi-year agreements: with federal funds, use the total anticipated contract value (e.g. $25K/year x 5 years = $125K must be bid and use the SSPR). BUS-43 alone looks at annual expenditures of more than $100,000.",
    "small_business:1": 'Certified small business/DVBE: may award up to $250,000 without formal bid, any funding source. BUS-43: 1 SB/DVBE quote for $10K-$100K; 2 quotes from certified SB/DVBEs above $100K. (SSPR form federal SB option: under $100K.) BUS-43 allows small business/DVBE awards "up to $250,000" but the SSPR form says "Only <$250k"; at exactly $250,000 confirm with Procurement.',
    "sole_source:1": "A sole source justification is required whenever a purchase is awarded without competition because only one supplier can meet the requirement. Allowable reasons - federal: one-of-a-kind, emergency, awarding agency approval, no competition (grants/coops only); non-federal: one-of-a-kind/unique, match existing (UC PO#). NOT allowable: pre-work with the supplier that excludes competition, price, brand name, familiarity, and (federal) geographic preference. Document in SSPR Section IV.",
    "sole_source:2": "Sole-sourced federal non-commercial contract orders >= $2,500,000 require certified cost or pricing data (FAR 15.403-4).",
    "split:1": "Split orders: requirements must not be artificially divided into separate transactions to avoid competition (BUS-43). Related orders are evaluated at their combined value.",
    "equipment:1": "BUS-29: equipment costing $5,000 or more must be inventoried, tagged, tracked, and assigned a CAAN (threshold was $1,500 before July 1, 2004). Items under $5,000 are not inventorial equipment. Accessories of $5,000+ acquired later must also be capitalized.",
    "micro:1": "Federal micro-purchase threshold: $15,000 (campus may set up to $50,000 for grants/cooperative agreements).",
    "sat:1": "Federal Simplified Acquisition Threshold: $350,000; UC still bids at $100,000 because the CA PCC is stricter.",
    "covered:1": "Regents Policy 5402 generally prohibits contracting out covered services that UC employees can perform: cleaning, custodial, janitorial, housekeeping, food services, laundry, grounds keeping, building maintenance, transportation, parking, security, nursing assistant, medical imaging, medical technician.",
    "covered:2": "Exceptions: Emergency; Insufficient UC staff to perform the work; Specialized expertise/equipment not available internally; Services incidental to a property lease; Urgent, temporary, or occasional need; Remote facility (more than 10 miles from campus); Registry personnel in clinical operations; Required by law, federal requirement, or court order. Contracting out must not displace UC employees (demotion, layoff, or involuntary reduction in time).",
    "covered:3": "Covered-service contracts over $100,000: notify AFSCME 3299 (30 days, or RFP copy at issuance; 14 days to respond). Over $100,000 and more than 90 days: wage/benefit parity.",
}
# Names that fill places.
ALLOWED = {
    "federal": "One-of-a-kind, Emergency, Awarding Agency Approval, No Competition (grant and cooperative agreement funds only)",
    "other": "One-of-a-kind/Unique, Match existing (list UC PO#)",
}
EXCEPTIONS = {
    "emergency": "Emergency", "insufficient_staff": "Insufficient UC staff to perform the work", "specialized_expertise": "Specialized expertise/equipment not available internally",
    "incidental_to_lease": "Services incidental to a property lease", "urgent_temporary": "Urgent, temporary, or occasional need", "remote_facility": "Remote facility (more than 10 miles from campus)",
    "registry_personnel": "Registry personnel in clinical operations", "required_by_law": "Required by law, federal requirement, or court order",
}
EXPOSURES = {
    "C": "C. Digital Risk - High", "D": "D. Physical Safety or Security Risk", "E": "E. Professional Services", "F": "F. Products - Controlled Substances / Medical Devices", "G": "G. International",
    "H": "H. Students or Minors", "I": "I. Use of Facilities", "J": "J. Financial Assets", "K": "K. Transportation",
}
# The policy of each flag; each form's reason and detail; each ladder's code.
POLICIES = {
    "SPLIT_ORDER": "BUS-43", "SELECTION_NOT_ALLOWED": "SSPR Form Section I", "SOLE_SOURCE_INVALID": "SSPR Form Section IV", "SOLE_SOURCE_JUSTIFICATION": "SSPR Form Section IV",
    "SB_FEDERAL_OVER_100K": "SSPR FAQ; SSPR Form Section I", "SB_LIMIT_EXCEEDED": "BUS-43; CA PCC 10508.5", "SB_CEILING_CONFLICT": "BUS-43 p.9/p.25; SSPR Form Section I",
    "CERTIFIED_COST_PRICING": "FAR 15.403-4; SSPR Form Section III", "FEDERAL_PORTION_BELOW_TRIGGER": "SSPR Form Rev. 12-2025 Section I", "COVERED_SERVICE": "Regents Policy 5402; AFSCME 3299 Article 5",
    "PHI": "Appendix BAA", "PHI_DEIDENTIFIED": "Appendix BAA", "DATA_SECURITY": "Appendix Data Security", "IS3": "IS-3", "BUS79": "BUS-79", "G41": "BFB-G-41", "G13": "BFB-G-13", "BUS50": "BUS-50",
    "VEHICLE": "UCPS 120029", "BUS63": "BUS-63",
}
FORM_LINES = {
    "SSPR Form": "SSPR Form: Sections {sections} ({selected})  [{value} meets the {form_threshold} SSPR threshold]",
    "Federal Funds Checklist": "Federal Funds Checklist  [federal requirements apply to this transaction]",
    "Anti-Lobbying Verification (Byrd Amendment)": "Anti-Lobbying Verification (Byrd Amendment)  [federal purchase of $100,000 or more]",
    "Debarment & Suspension Verification": "Debarment & Suspension Verification  [required for all federally funded orders]",
    "FAR Flow-Down Articles": "FAR Flow-Down Articles: UC Terms & Conditions Articles 8.1(a) or 8.1(b), 1, 11.10  [federal contract funds]",
    "Uniform Guidance (2 CFR 200) Flow-Down Articles": "Uniform Guidance (2 CFR 200) Flow-Down Articles: UC Terms & Conditions Articles 1, 8.1(c)(i-v), 11.8, 11.9, 11.10 - these cannot be deleted or edited  [federal grant/cooperative agreement funds]",
    "UC Certified Cost or Pricing Data for Federal Contract Purchases": "UC Certified Cost or Pricing Data for Federal Contract Purchases: FAR 15.403-4  [sole-sourced federal non-commercial contract order of $2,500,000 or more]",
    "Appendix Data Security": "Appendix Data Security  [vendor accesses UC institutional data]",
    "Business Associate Agreement (BAA)": "Business Associate Agreement (BAA)  [vendor accesses protected health information (HIPAA)]",
    "IS-3 Compliance": "IS-3 Compliance  [vendor provides IT services/software/cloud with UC data]",
}
LADDERS = {"post_employment": "POST_EMPLOYMENT", "business_meal": "BUSINESS_MEAL_DOCS", "alcohol_permit": "ALCOHOL_PERMIT", "risk_matrix": "RISK_MATRIX_COI"}
#: Flags whose message is a prohibition, which the answer's line begins with.
PROHIBITIONS = ("SPLIT_ORDER", "SOLE_SOURCE_INVALID", "SB_LIMIT_EXCEEDED")
