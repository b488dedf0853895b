"""Short corpora in the shapes that artifacts have."""

OAUTH = [
    ("adr", "2023-01-11", "# ADR 004: Service-to-Service Authentication\n\n## Status\nSuperseded\n\n## Context\nInternal services need to authenticate calls between each other.\n\n## Decision\nUse JWT for service-to-service authentication.\n\n## Consequences\nToken revocation is not possible before expiry.\n"),
    ("adr", "2024-05-02", "# ADR 012: Replace JWT with OAuth2 Client Credentials\n\n## Status\nAccepted\n\n## Context\nJWT cannot be revoked before expiry, which blocks incident response.\n\n## Decision\nUse OAuth2 for service-to-service authentication.\n\n## Consequences\nOAuth2 introduces a dependency on the token service.\n"),
    ("pull_request", "2024-05-20", "Migrate the API Gateway to OAuth2.\n\nReason:\nUse OAuth2 for service-to-service authentication, because it supports token revocation.\n\nTrade-off:\nAdds a network hop to the token service on every request.\n"),
    ("commit", "2024-06-03", "Remove JWT signing keys from the config service.\n\nReason:\nUse OAuth2 for service-to-service authentication across all internal services.\n"),
]

QUEUE = [
    ("adr", "2022-08-01", "# ADR 007: Asynchronous Messaging\n\n## Decision\nUse RabbitMQ for asynchronous messaging.\n\n## Consequences\nWe take on a broker that nobody on call has operated before.\n"),
    ("adr", "2024-11-12", "# ADR 019: Consolidate on Kafka\n\n## Context\nThe analytics pipeline already runs on Kafka, so we operate two brokers for no\nparticular reason. Retention semantics differ, which has bitten us twice.\n\n## Decision\nUse Kafka for asynchronous messaging.\n\nKafka now replaces RabbitMQ.\n\n## Consequences\nThe order service depends on Kafka. Migration is not free; consumers must be rewritten.\n"),
    ("pull_request", "2024-12-03", "Port the order consumer to Kafka.\n\nReason:\nThe order service uses Kafka, and the notification worker uses Kafka.\n\nTrade-off:\nConsumer rebalancing is harder to reason about than acknowledgements were.\n"),
    ("issue", "2025-01-15", "Decommission the RabbitMQ cluster.\n\nThe order service must not use RabbitMQ after this lands.\n\nNothing depends on the broker once the notification worker is ported.\n"),
]


def artifacts(spark, rows):
    from tessarion.operators.compiler import with_artifact_ids

    data = [(k, *r) for k, r in enumerate(rows)]
    return with_artifact_ids(spark.createDataFrame(data, "ingest_seq bigint, type string, recorded_at string, content string"))
